"""The flow graph compiled to one plan (M13-M16): steps are DataFrame transforms, a step with
several successors is a shared prefix, outputs are named results."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import mapping

MOST_NODES = 200
RECORDS, OBSERVATIONS = "records", "observations"
#: What a step takes and gives.
KINDS: dict[str, tuple[str | None, str | None]] = {
    "input": (None, RECORDS), "reject": (RECORDS, RECORDS), "map": (RECORDS, OBSERVATIONS), "filter": (OBSERVATIONS, OBSERVATIONS),
    "affiliation": (OBSERVATIONS, OBSERVATIONS), "registry": (OBSERVATIONS, OBSERVATIONS), "throttle": (OBSERVATIONS, OBSERVATIONS),
    "tracker": (OBSERVATIONS, OBSERVATIONS), "output": (OBSERVATIONS, None), "topic": (OBSERVATIONS, None),
}
ENDS = ("output", "topic")


class Flow:
    """A graph of steps: ``nodes`` {id, type, config} and ``edges`` {source, target}."""

    def __init__(self, spec: dict[str, Any], steps: dict[str, Callable[[DataFrame, Any], DataFrame]] | None = None):
        self.nodes = {n["id"]: n for n in spec["nodes"]}
        self.spec, self.edges = spec, [(e["source"], e["target"]) for e in spec["edges"]]
        self.steps = {"reject": self._reject, "map": self._map, "filter": mapping.keep_drop, "affiliation": self._affiliation} | (steps or {})

    def problems(self) -> list[tuple[str, str]]:
        """(severity, message): ``invalid`` graphs cannot run, ``incomplete`` ones do nothing useful."""
        out: list[tuple[str, str]] = []
        ids = [n["id"] for n in self.spec["nodes"]]
        kinds = [n["type"] for n in self.spec["nodes"]]
        if len(ids) > MOST_NODES:
            out.append(("invalid", f"more than {MOST_NODES} steps"))
        if len(set(ids)) < len(ids):
            out.append(("invalid", "two steps have one id"))
        out += [("invalid", f"unknown step {k}") for k in kinds if k not in KINDS]
        if kinds.count("input") != 1:
            out.append(("invalid" if kinds.count("input") else "incomplete", "a flow has one input"))
        if kinds.count("output") > 1:
            out.append(("invalid", "a flow has at most one output"))
        taken: dict[str, int] = {}
        for a, b in self.edges:
            if a not in self.nodes or b not in self.nodes:
                out.append(("invalid", f"edge {a} to {b} names no step"))
                continue
            gives, takes = KINDS.get(self.nodes[a]["type"], (None, None))[1], KINDS.get(self.nodes[b]["type"], (None, None))[0]
            if gives is None or takes is None or gives != takes:
                out.append(("invalid", f"{b} does not take what {a} gives"))
            taken[b] = taken.get(b, 0) + 1
        out += [("invalid", f"{b} has several inputs") for b, n in taken.items() if n > 1]
        if self.order() is None:
            out.append(("invalid", "the flow has a loop"))
        out += [("incomplete", f"{i} is not connected") for i, n in self.nodes.items() if n["type"] != "input" and i not in taken]
        if not any(k in ENDS for k in kinds):
            out.append(("incomplete", "nothing leaves the flow"))
        return out

    def order(self) -> list[str] | None:
        """Steps, each after its predecessor; None if there is a loop."""
        waiting = {i: sum(b == i for _, b in self.edges) for i in self.nodes}
        ready, out = [i for i, n in waiting.items() if not n], []
        while ready:
            at = ready.pop(0)
            out.append(at)
            for a, b in self.edges:
                if a == at and b in waiting:
                    waiting[b] -= 1
                    if not waiting[b]:
                        ready.append(b)
        return out if len(out) == len(self.nodes) else None

    def run(self, records: DataFrame) -> dict[str, DataFrame]:
        """The DataFrame after every step; read those of the outputs.  Spark evaluates only
        what is read, and optimizes across the steps."""
        if bad := [m for severity, m in self.problems() if severity == "invalid"]:
            raise ValueError("; ".join(bad))
        before = {b: a for a, b in self.edges}
        made: dict[str, DataFrame] = {}
        for i in self.order() or []:
            node = self.nodes[i]
            if node["type"] == "input":
                made[i] = records
            elif i in before and before[i] in made:
                df = made[before[i]]
                made[i] = df if node["type"] in ENDS else self.steps[node["type"]](df, node.get("config"))
        return made

    def outputs(self, records: DataFrame) -> dict[str, DataFrame]:
        return {i: df for i, df in self.run(records).items() if self.nodes[i]["type"] in ENDS}

    def counts(self, records: DataFrame) -> DataFrame:
        """Rows (step, passed) of every step."""
        rows = [df.agg(F.count("*").alias("passed")).select(F.lit(i).alias("step"), "passed") for i, df in self.run(records).items()]
        out = rows[0]
        for each in rows[1:]:
            out = out.union(each)
        return out

    def dry_run(self, records: DataFrame, most: int = 1000) -> dict[str, DataFrame]:
        """The same plan over the first ``most`` records."""
        return self.run(records.limit(most))

    @staticmethod
    def line(steps: list[tuple[str, Any]]) -> Flow:
        """A flow without branches, as older specs have it."""
        named = [("input", None), *steps]
        nodes = [{"id": f"{i}-{kind}", "type": kind, "config": config} for i, (kind, config) in enumerate(named)]
        return Flow({"nodes": nodes, "edges": [{"source": a["id"], "target": b["id"]} for a, b in zip(nodes, nodes[1:], strict=False)]})

    @staticmethod
    def _reject(df: DataFrame, rules: list[dict]) -> DataFrame:
        return mapping.reject(df, rules).where("reject_reason is null").drop("reject_reason")

    @staticmethod
    def _map(df: DataFrame, config: dict) -> DataFrame:
        return mapping.map_records(df, config["mapping"], tuple(config.get("keep", ())))

    @staticmethod
    def _affiliation(df: DataFrame, config: dict) -> DataFrame:
        at = "classification.affiliation"
        already = F.col(f"`{at}`") if at in df.columns else None
        return df.withColumn(at, mapping.affiliation(F.col(f"`{config['country']}`"), config["lists"], config.get("otherwise"), config.get("unknown"), already))

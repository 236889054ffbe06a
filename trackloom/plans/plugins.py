"""Named extensions of a plan (section 2.11): codecs, trackers and scorers by name.

An extension is registered in the driver's program under its kind and name, as a factory
that takes options and returns a function over batches; a plan names it.  The function runs
in tasks, so what it needs travels with it.  What fails stays small: a batch that raises is
halved until the rows at fault are alone, and those keep what the plan had without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("codec", "tracker", "scorer")
_KNOWN: dict[tuple[str, str], tuple[str, dict[str, type], Callable[..., Callable]]] = {}


def register(kind: str, name: str, version: str, factory: Callable[..., Callable], options: dict[str, type] | None = None) -> None:
    """Make ``factory`` known; ``options`` are the names and types that it takes.

    What it returns is called with a pandas DataFrame: a *codec* with rows (frame), returning
    for each a list of messages (dicts); a *scorer* with the pairs, returning rows
    (ln_lr, pass, evidence), one for each; a *tracker* with the plots of one source in
    order, returning rows of the schema that the plan names.
    """
    if kind not in KINDS:
        raise ValueError(f"kind {kind!r}: one of {', '.join(KINDS)}")
    _KNOWN[kind, name] = version, dict(options or {}), factory


def unregister(kind: str, name: str) -> None:
    _KNOWN.pop((kind, name), None)


def installed() -> list[tuple[str, str, str]]:
    """(kind, name, version) of all that is known."""
    return sorted((kind, name, version) for (kind, name), (version, _, _) in _KNOWN.items())


def problems(kind: str, name: str, options: dict[str, Any]) -> list[str]:
    """What is wrong with naming this extension with these options."""
    if (kind, name) not in _KNOWN:
        return [f"no {kind} {name!r}"]
    takes = _KNOWN[kind, name][1]
    wrong = [f"{n}: not an option of {name}" for n in sorted(set(options) - set(takes))]
    return wrong + [f"{n}: {takes[n].__name__} expected" for n, v in sorted(options.items()) if n in takes and not isinstance(v, (int, float) if takes[n] is float else takes[n])]


def _made(kind: str, name: str, options: dict[str, Any]) -> tuple[str, Callable]:
    wrong = problems(kind, name, options)
    if wrong:
        raise ValueError("; ".join(wrong))
    version, _, factory = _KNOWN[kind, name]
    return f"{name}-{version}", factory(**options)


def _halved(call: Callable[[pd.DataFrame], Any], rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Any]]:
    """Parts of ``rows`` in order with what ``call`` says of each; of single rows that fail, the error."""
    stack = [rows]
    while stack:
        part = stack.pop()
        try:
            said = call(part.reset_index(drop=True))
            if len(said) != len(part):
                raise ValueError(f"{len(said)} results for {len(part)} rows")
        except Exception as e:  # noqa: BLE001 - an extension's faults are data here
            if len(part) > 1:
                stack += [part.iloc[len(part) // 2 :], part.iloc[: len(part) // 2]]
                continue
            said = e
        yield part, said


def score(pairs: DataFrame, name: str, **options: Any) -> DataFrame:
    """``pairs`` (with ln_lr double and pass boolean) with the scorer's ln_lr and pass in their
    place, and columns ``scorer`` (name-version) and ``evidence`` (text).

    A pair that the scorer fails on, or gives a ratio that is null or not finite, keeps its
    own ln_lr and pass; one that it fails on has neither scorer nor evidence.  A scorer that
    is not installed leaves all pairs as they are.  Pairs are judged in Arrow batches, each pair by itself.
    """
    taken = [n for n in ("scorer", "evidence") if n in pairs.columns]
    if taken:
        raise ValueError(f"the pairs have columns {taken} already")
    if ("scorer", name) not in _KNOWN:
        return pairs.withColumns({"scorer": F.lit(None).cast("string"), "evidence": F.lit(None).cast("string")})
    label, judge = _made("scorer", name, options)
    schema = T.StructType([*pairs.schema, T.StructField("scorer", T.StringType()), T.StructField("evidence", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, said in _halved(judge, batch) if len(batch) else ():
                out = part.reset_index(drop=True)
                if isinstance(said, Exception):
                    yield out.assign(scorer=None, evidence=None)
                    continue
                ratio = pd.to_numeric(said["ln_lr"], errors="coerce").astype(float).to_numpy()
                sound = np.isfinite(ratio)
                texts = said["evidence"].to_numpy() if "evidence" in said else None
                yield out.assign(ln_lr=np.where(sound, ratio, out["ln_lr"]), **{"pass": np.where(sound, said["pass"].to_numpy(), out["pass"])}, scorer=label, evidence=texts)

    return pairs.mapInPandas(work, schema)


def decode(frames: DataFrame, name: str, *, frame_col: str = "frame", **options: Any) -> DataFrame:
    """A row for each message that the codec finds in a frame: the columns of ``frames``, with
    ``message`` (variant), ``at`` (its place in the frame, from 0) and ``fault``.  A frame that
    the codec fails on is one row with the fault's text and no message; one without messages gives none."""
    import json

    _, read = _made("codec", name, options)
    inner = T.StructType([*frames.schema, T.StructField("message", T.StringType()), T.StructField("at", T.LongType()), T.StructField("fault", T.StringType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, said in _halved(lambda rows: read(rows[frame_col]), batch) if len(batch) else ():
                if isinstance(said, Exception):
                    yield part.assign(message=None, at=None, fault=str(said) or type(said).__name__)
                    continue
                times = [len(messages) for messages in said]
                out = part.iloc[np.repeat(np.arange(len(part)), times)]
                yield out.assign(message=[json.dumps(m) for messages in said for m in messages], at=[i for n in times for i in range(n)], fault=None)

    return frames.mapInPandas(work, inner).withColumn("message", F.try_parse_json("message"))


def track(plots: DataFrame, name: str, schema: str, *, by: str = "source_id", order: str = "t_us", **options: Any) -> DataFrame:
    """The tracker's rows for each source: its plots in order are one call, as a tracker's state is
    one source's.  A tracker that fails stops the query, as tracks without some plots would be wrong."""
    _, follow = _made("tracker", name, options)
    return plots.groupBy(by).applyInPandas(lambda pdf: follow(pdf.sort_values(order, kind="stable").reset_index(drop=True)), schema)

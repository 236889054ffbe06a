"""How often a sensor comes back, and the windows that trackers take from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.folds import Fold, run

#: Periods whose median counts, how long a silent job still counts, revisits and least seconds of the windows, change that is none.
KEEP = 9
ACTIVE_MS = 60_000
WINDOWS = {"confirm_within_s": (3.5, 20.0), "drop_tentative_s": (1.3, 8.0), "drop_confirmed_s": (2.5, 30.0)}
HYSTERESIS = 0.05


def revisits(dwells: DataFrame) -> DataFrame:
    """Rows (stream, seq, t_ms, job, period_s, measured) after each dwell: its job's period.

    ``dwells``: stream, seq (their order), job, revisit (16 bits), t_ms, nominal_s.  A revisit
    begins with the first dwell of its index; if that follows the one before (65,535 is followed
    by 0) at a later time, the one before took the time between.  The period is the upper median
    of a job's last nine; before the first, what the job says (null or 0: nothing).
    """
    job = Window.partitionBy("stream", "job").orderBy("seq")
    upto = job.rowsBetween(Window.unboundedPreceding, 0)
    rows = dwells.withColumn("_was", F.lag("revisit").over(job)).withColumn("_new", F.col("_was").isNull() | (F.col("_was") != F.col("revisit")))
    rows = rows.withColumn("_begun", F.last(F.when(F.col("_new"), F.col("t_ms")), ignorenulls=True).over(job.rowsBetween(Window.unboundedPreceding, -1)))
    follows = F.col("_new") & (F.pmod(F.col("_was") + 1, F.lit(65536)) == F.col("revisit")) & (F.col("t_ms") > F.col("_begun"))
    rows = rows.withColumn("_period", F.when(follows, F.col("t_ms") - F.col("_begun")))
    number = F.count("_period").over(upto)
    rows = rows.withColumn("_no", number)
    # The last nine periods lie among rows whose count is within nine of this one's.
    nine = Window.partitionBy("stream", "job").orderBy("_no").rangeBetween(1 - KEEP, 0)
    last = F.sort_array(F.collect_list("_period").over(nine))
    rows = rows.withColumn("_last", last)
    measured = F.get("_last", F.expr("size(_last) div 2")) / 1000.0
    return rows.select("stream", "seq", "t_ms", "job", F.coalesce(measured, F.when(F.col("nominal_s") > 0, F.col("nominal_s"))).alias("period_s"), measured.isNotNull().alias("measured"))


def governing(periods: DataFrame) -> DataFrame:
    """Rows (stream, seq, job, period_s, measured) after each dwell: the longest period of the
    stream's jobs that are active, the lowest job of equal ones; null before any.

    A job is active for a minute after its last dwell, or for three of its periods if that is
    longer.  Every dwell meets every job of its stream, of which there are few.
    """
    jobs = periods.select("stream", F.col("job").alias("other")).distinct()
    met = periods.join(jobs, "stream")
    own = F.when(F.col("job") == F.col("other"), F.struct("t_ms", "period_s", "measured"))
    known = F.last(own, ignorenulls=True).over(Window.partitionBy("stream", "other").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    met = met.withColumn("_k", known)
    active = F.abs(F.col("t_ms") - F.col("_k.t_ms")) <= F.greatest(F.lit(ACTIVE_MS), F.floor(F.col("_k.period_s") * 3000.0))
    best = F.max(F.when(active & F.col("_k.period_s").isNotNull(), F.struct(F.col("_k.period_s").alias("period_s"), (-F.col("other")).alias("job"), F.col("_k.measured").alias("measured"))))
    return met.groupBy("stream", "seq").agg(best.alias("b")).select("stream", "seq", (-F.col("b.job")).alias("job"), "b.period_s", "b.measured")


def windows(governed: DataFrame, *, hysteresis: float = HYSTERESIS) -> DataFrame:
    """Rows (stream, seq, revisit_s, confirm_within_s, drop_tentative_s, drop_confirmed_s): the
    windows in force after each dwell (T8), null while no period is known.

    They are multiples of the period, never below a least one, and follow a new period only if it
    is measured otherwise or differs by more than ``hysteresis`` from the one in force.
    """

    def step(state: tuple | None, row: dict):
        period, measured = row["period_s"], row["measured"]
        if period is not None and period > 0 and (state is None or state[1] != measured or abs(state[0] - period) > hysteresis * state[0]):
            state = (period, measured)
        return state, [{"stream": row["stream"], "seq": row["seq"], "revisit_s": state[0] if state else None}]

    kinds = dict(governed.dtypes)
    held = run(governed.select("stream", "seq", "period_s", "measured"), Fold(lambda: None, step, f"stream {kinds['stream']}, seq {kinds['seq']}, revisit_s double"), ["stream"], ["seq"])
    return held.withColumns({name: F.when(F.col("revisit_s").isNotNull(), F.greatest(F.col("revisit_s") * times, F.lit(least))) for name, (times, least) in WINDOWS.items()})

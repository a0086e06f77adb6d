"""Ordered steps reached by each subject, with any other events between them.

A time slice of a subject is a function: entered with so many steps done, it is left with so many. A slice's events are folded once for every
entry, so slices are aggregated apart from each other, also on different days, and composed per subject afterwards. Steps are
matched as early as possible; a step counts if it is later than the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def slice_states(events: DataFrame, steps: list[str], subject: str = "user_id", kind: str = "event_type", at: str = "ts", seconds: int = 3600) -> DataFrame:
    """(subject, slice, states): for each number of steps done on entry, the number done on leaving and the times of those added.

    Only events of the steps are shuffled. A step may be named twice. A slice holds one subject's `seconds`. Events without
    subject, kind or time are left out; repeated events do no harm."""
    wanted = events.where(F.col(kind).isin(steps) & F.col(subject).isNotNull() & F.col(at).isNotNull())
    found = wanted.select(F.col(subject).alias("subject"), F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)).alias("slice"), F.col(at).cast("timestamp").alias("at"), F.col(kind).alias("kind"))
    of_slice = found.groupBy("subject", "slice").agg(F.array_sort(F.collect_set(F.struct("at", "kind"))).alias("seen"))  # one subject's slice

    def fold(entry: int) -> Column:
        start = F.struct(F.lit(entry).cast("int").alias("done"), F.array().cast("array<timestamp>").alias("times"))
        names = F.array(*map(F.lit, steps))

        def step(state: Column, event: Column) -> Column:
            due = F.get(names, state["done"]) == event["kind"]
            later = (F.size(state["times"]) == 0) | (F.get(state["times"], F.size(state["times"]) - 1) < event["at"])
            return F.when(F.coalesce(due & later, F.lit(False)), F.struct((state["done"] + 1).alias("done"), F.array_append(state["times"], event["at"]).alias("times"))).otherwise(state)

        return F.aggregate("seen", start, step)

    return of_slice.select("subject", "slice", F.array(*[fold(k) for k in range(len(steps) + 1)]).alias("states"))


def compose(slices: DataFrame) -> DataFrame:
    """(subject, done, times) from slices, in the order of time; slices may come from several tables or runs."""
    ordered = slices.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("slice", "states"))).alias("parts"))  # at most one for each slice
    start = F.struct(F.lit(0).cast("int").alias("done"), F.array().cast("array<timestamp>").alias("times"))

    def enter(state: Column, part: Column) -> Column:
        out = F.get(part["states"], state["done"])
        return F.struct(out["done"].alias("done"), F.concat(state["times"], out["times"]).alias("times"))

    return ordered.select("subject", F.aggregate("parts", start, enter).alias("_s")).select("subject", "_s.done", "_s.times")


def funnel(slices: DataFrame, steps: list[str]) -> DataFrame:
    """(position, step, subjects, before, seconds): subjects that reach each step, those that reached the one before, and whole seconds since their first step."""
    reached = compose(slices).select("subject", "done", "times", F.posexplode(F.slice("times", F.lit(1), F.greatest(F.col("done"), F.lit(1)))).alias("k", "at"))
    counted = reached.groupBy("k").agg(
        F.count("*").alias("subjects"), F.sum(F.floor((F.unix_micros("at") - F.unix_micros(F.get("times", F.lit(0)))) / 1_000_000)).cast("bigint").alias("seconds"))
    names = slices.sparkSession.createDataFrame([(k, s) for k, s in enumerate(steps)], "k int, step string")
    full = names.join(counted, "k", "left").select("k", "step", F.coalesce("subjects", F.lit(0)).alias("subjects"), F.coalesce("seconds", F.lit(0)).alias("seconds"))
    earlier = full.select((F.col("k") + 1).alias("k"), F.col("subjects").alias("before"))
    return full.join(earlier, "k", "left").select((F.col("k") + 1).alias("position"), "step", "subjects", F.coalesce("before", "subjects").alias("before"), "seconds")

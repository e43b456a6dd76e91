"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations.

Method
------
Sources take weights (and weight schedules) by rank. Their targets share the total size;
a target stops at ``max_epochs`` times its source's size and what is over is shared again
by weight. Sharing again until nothing is over has a closed form: with sources sorted by
cap / weight, those whose cap lies below the common share of the rest are capped.

Inside a source documents stand in the order of md5 of their ids. A source's token demand
up to training time t is its target times the integral of its schedule over [0, t]; the
inverse of that curve gives the time at which a document's tokens are due, once per pass
over the source. Occurrences are sorted by that time with a range sort.

The running size inside a source comes from two levels: sums per (source, hash range), then
rows within a range. Both levels grow with the square root of the rows, so a source that
holds a third of all rows is dealt out like any other.

Edge cases
----------
Null text has size 0. Null sources form one source, ranked last. Documents of size 0 and
all documents of a source whose target is used up are not taken (``taken`` 0). Null ids
order before others of their source; repeated rows are taken like separate documents.
An empty table gives an empty result. The one document at a source's target may be taken
in part, so that the taken sizes add up to the target rounded to a whole word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailsift.llm.common import WORD, materialize
from trailsift.operators.components import dense_index

#: Schedules by rank, repeating: knots (time, relative weight), linear in between.
Schedule = Sequence[tuple[float, float]]
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),               # steady
    ((0.0, 0.5), (0.6, 1.0), (1.0, 2.0)),   # late
    ((0.0, 2.0), (0.4, 1.0), (1.0, 0.5)),   # early
)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _source_key(source: Column) -> Column:
    """A text that joins null sources too."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def source_targets(sums: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """(key, source, source_size, rank, target) from (key, source, size) rows.

    One row per source goes through one task.
    """
    per = sums.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("rank") % len(weights)) + 1).cast("int"))
    per = (per.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight)
           .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
           .withColumn("ratio", F.col("cap") / F.col("weight")))
    every = Window.partitionBy(F.lit(0))
    lower = every.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("total", F.sum("source_size").over(every).cast("double"))
           .withColumn("all_weight", F.sum("weight").over(every))
           .withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(lower), F.lit(0.0)))
                       / (F.col("all_weight") - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))))
           .withColumn("capped", F.col("ratio") < F.col("share")))
    free = F.col("all_weight") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    return (per.withColumn("free", free).withColumn("rest", rest)
            .withColumn("target", F.when(F.col("capped") | (F.col("free") <= 0), F.col("cap"))
                        .otherwise(F.least("cap", F.col("weight") * F.col("rest") / F.col("free"))))
            .select("key", "source", "source_size", "rank", "target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``docs`` with struct ``mix``: size, source_size, target, rank, offset, taken (array by pass).

    The size of a text is counted once here; columns of ``docs`` other than the three named
    pass through, but for columns named as the new ones, which give way.
    """
    docs = docs.drop("mix", "mix_pass", "mix_taken", "mix_time")
    key = _source_key(F.col(source_col))
    ident = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select("*", F.struct(key.alias("key"), word_count(F.col(text_col)).alias("size"),
                                      ident.alias("order")).alias("mix"))
    return _taken(sized, id_col, source_col, weights, max_epochs)


def _taken(sized: DataFrame, id_col: str, source_col: str, weights, max_epochs: int) -> DataFrame:
    narrow = materialize(sized.select(F.col("mix.key").alias("key"), F.col(source_col).cast("string").alias("source"),
                                      F.col("mix.size").alias("size"), F.col("mix.order").alias("order")), "mix-sizes")
    rows = narrow.count()
    ranges = max(16, int(rows ** 0.5))
    # The first 32 bits of the order, scaled to a range number: ranges follow the order.
    def hash_range(order: Column) -> Column:
        return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32) * ranges).cast("long")

    sums = materialize(narrow.groupBy("key", hash_range(F.col("order")).alias("range"))
                       .agg(F.max("source").alias("source"), F.sum("size").alias("size")), "mix-ranges")
    targets = source_targets(sums, weights, max_epochs)
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        sums.withColumn("range_offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select(
            "key", "range", "range_offset").join(targets.drop("source"), "key"), "mix-offsets")
    placed = sized.withColumn("__key", F.col("mix.key")).withColumn("__range", hash_range(F.col("mix.order"))).join(
        offsets.withColumnsRenamed({c: f"__{c}" for c in offsets.columns}), ["__key", "__range"])
    inside = Window.partitionBy("__key", "__range").orderBy("mix.order", id_col, "mix.size").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.col("__range_offset") + F.coalesce(F.sum("mix.size").over(inside), F.lit(0))
    placed = placed.withColumn("__start", start)
    quota = F.floor(F.col("__target") + 0.5)
    taken = F.array(*[F.greatest(F.lit(0), F.least(
        F.col("mix.size"), quota - F.lit(e) * F.col("__source_size") - F.col("__start"))).cast("long")
        for e in range(max_epochs)])
    return placed.withColumn("mix", F.struct(
        F.col("mix.size").alias("size"), F.col("mix.order").alias("order"),
        F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__rank").alias("rank"), F.col("__start").alias("start"), taken.alias("taken"))).drop(
        "__key", "__range", "__range_offset", "__source_size", "__target", "__rank", "__start")


def _segments(schedule: Schedule) -> list[tuple[float, ...]]:
    """(t0, w0, slope, c0, c1): the schedule's pieces with the share of demand before and after."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / total
        out.append((t0, w0 / total, (w1 - w0) / (t1 - t0) / total, done, done + part))
        done += part
    return out


def due_time(share: Column, schedule: Schedule) -> Column:
    """The time at which ``share`` of a source's demand is due: the inverse of the integral."""
    out = None
    for t0, w0, slope, c0, c1 in reversed(_segments(schedule)):
        left = F.greatest(share - F.lit(c0), F.lit(0.0))
        # w0 * x + slope * x * x / 2 = left, in a form that also holds for slope 0.
        x = F.lit(2.0) * left / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0))))
        out = F.lit(t0) + x if out is None else F.when(share <= F.lit(c1), F.lit(t0) + x).otherwise(out)
    return F.least(out, F.lit(1.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3,
        schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """Occurrences in training order: ``docs`` with ``mix_pass``, ``mix_taken``, ``mix_time``."""
    return occurrences(plan_mix(docs, id_col, text_col, source_col, weights, max_epochs), schedules)


def occurrences(planned: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """The taken passes of a ``plan_mix``, sorted by the time at which each is due."""
    seen = planned.select("*", F.posexplode("mix.taken").alias("mix_pass", "mix_taken")).filter("mix_taken > 0")
    share = (F.col("mix_pass") * F.col("mix.source_size") + F.col("mix.start") + F.col("mix_taken") / 2.0) \
        / F.floor(F.col("mix.target") + 0.5)
    time = None
    for i, schedule in enumerate(schedules):
        due = due_time(share, schedule)
        time = due if time is None else F.when(F.col("mix.rank") % len(schedules) == i, due).otherwise(time)
    return (seen.withColumn("mix_time", time).orderBy("mix_time", "mix.rank", "mix.order", "mix_pass"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[float] = (1, 2, 3), max_epochs: int = 3,
                    schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """(id, size, source_size, target, taken, due_time, position): every document once, sorted by position.

    ``taken`` is the sum over a document's occurrences, ``due_time`` the training time (0 to 1) at which its
    source's schedule first calls for it, and ``position`` its place among all documents in that order, from 0.
    What is not taken has neither and comes last.
    """
    planned = materialize(plan_mix(docs, id_col, text_col, source_col, weights, max_epochs)
                          .select(F.col(id_col).alias("id"), "mix"), "mix-planned")
    # A document that is taken has words, so no other one of its source starts where it does.
    met = occurrences(planned, schedules).groupBy("mix.rank", "mix.start").agg(
        F.max(F.struct("id", "mix.size", "mix.source_size", "mix.target")).alias("doc"),
        F.sum("mix_taken").alias("taken"),
        F.min(F.struct("mix_time", "mix.rank", "mix.order", "mix_pass")).alias("due")).select("doc.*", "taken", "due")
    met = dense_index(met, ["due", "id"], "position").withColumn("due_time", F.col("due.mix_time")).drop("due")
    rest = planned.filter(~F.exists("mix.taken", lambda x: x > 0)).select(
        "id", "mix.size", "mix.source_size", "mix.target", F.lit(0).cast("long").alias("taken"),
        F.lit(None).cast("long").alias("position"), F.lit(None).cast("double").alias("due_time"))
    return met.unionByName(rest).orderBy(F.col("position").asc_nulls_last(), "id").select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken", "due_time", "position")

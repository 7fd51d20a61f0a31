"""Source mixing with DataFrame functions: a curriculum of sources with weights that change over time.

1. Targets. Sources get a weight by their place in code-point order (null last) and
   share ``share`` times all words by weight. A target stops at ``cap`` times its
   source's words; the excess goes to the others by weight. The fixed point is one
   level for all sources that aren't capped, found from running sums over the sources
   in the order in which they reach their caps.
2. Order. A source's documents follow each other by a hash, so their words form one
   stream, repeated when the target exceeds it. A document's place is the running sum
   of sizes before it: sums of ``buckets`` hash classes first, then within a class, so
   that no source, however large, is summed in one task.
3. Time. Each weight class has a schedule, piecewise linear over training time 0 .. 1
   and scaled to area 1. Its integral times the target is the source's demand by that
   time; the inverse gives the time at which a document's first word is due.
4. ``by_position`` range-sorts the documents by the time of their first word;
   ``training_order`` has one row for each pass over a document, sorted likewise.

A document's taken words are those of its passes that lie before the target, which
is rounded to whole words: the sum over a source is its target to half a word.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of
its own; repeated rows are taken each; null or repeated ids are spread by their text;
equal hashes go by id, then by text hash;
input columns whose names this operator also writes get the suffix ``_input``;
without any words all targets are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.text import free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, BUCKETS = (3.0, 1.0, 2.0), 1.5, 2.0, 4096
#: (time, relative weight) knots for each place in ``WEIGHTS``: steady, rising, falling.
SCHEDULES = ([(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.6, 1.0), (1.0, 1.5)], [(0.0, 1.5), (0.4, 1.0), (1.0, 0.5)])
PLAN_COLUMNS = ["size", "source_size", "target", "taken", "passes"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), one row per source."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("place", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))) \
        .withColumn("weight", F.element_at(listed, F.col("place") + 1)) \
        .withColumn("most", F.lit(cap) * F.col("source_size"))
    full_first = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy(F.lit(0))
    rows = (rows
            .withColumn("capped", F.sum("most").over(full_first) - F.col("most"))
            .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(full_first) + F.col("weight"))
            .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
            .withColumn("holds", F.col("level") <= F.col("most") / F.col("weight"))
            .withColumn("nth", F.row_number().over(full_first)))
    level = F.min(F.when(F.col("holds"), F.struct("nth", "level"))).over(everything)["level"]
    return rows.withColumn("at", level).select(
        "source", "source_size", "place",
        F.least(F.col("most"), F.coalesce(F.col("at") * F.col("weight"), F.col("most"))).alias("target"))


def _segments(knots) -> list[tuple[float, float, float, float]]:
    """(time, demand before, weight, slope) of each piece, scaled so that the whole demand is 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if knots[0][0] != 0 or knots[-1][0] != 1 or area <= 0 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule runs from time 0 to 1 with weights of at least 0, not all 0")
    out, before = [], 0.0
    for (t, w), (u, v) in zip(knots, knots[1:]):
        out.append((t, before, w / area, (v - w) / area / (u - t)))
        before += (u - t) * (w + v) / 2 / area
    return out


def due_time(place: Column, demand: Column, schedules=SCHEDULES) -> Column:
    """Time at which the integral of the place's schedule reaches ``demand`` (0 .. 1)."""
    names = ("time", "before", "weight", "slope")
    table = F.array(*[F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, seg)])
                                for seg in _segments(k)]) for k in schedules])
    pieces = F.element_at(table, F.pmod(place, F.lit(len(schedules))).cast("int") + 1)
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= F.greatest(demand, F.lit(0.0))), -1)
    rest = F.greatest(demand - piece["before"], F.lit(0.0))
    root = F.sqrt(F.greatest(piece["weight"] * piece["weight"] + 2 * piece["slope"] * rest, F.lit(0.0)))
    under = piece["weight"] + root
    return F.least(F.lit(1.0), piece["time"] + F.when(under > 0, 2 * rest / under).otherwise(0.0))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES,
             buckets: int = BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """The documents with size, source_size, target, taken and passes (copy, taken, position).

    ``carry`` names the input columns to keep, the id among them; by default all.
    What isn't carried, the text above all, isn't shuffled.
    """
    keep = [F.col(f"`{c}`").alias(c + "_input" if c in PLAN_COLUMNS else c) for c in carry or docs.columns]
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    order = F.xxhash64(F.col(f"`{id_col}`").cast("string"), source.cast("string"), text)
    rows = docs.select(
        F.struct(*keep).alias("row"), source.alias("source"),
        # One text key for the joins: null is not the empty name.
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("h"), F.pmod(order, F.lit(buckets)).cast("int").alias("bucket"),
        F.xxhash64(text).alias("tie"))
    ranges = rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("size")).checkpoint()
    sums = ranges.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, cap).select(
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("key"),
        "source_size", "target", "place")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranges.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
              .join(targets, "key").select("key", "bucket", "start", "source_size", "target", "place"))
    inside = (Window.partitionBy("key", "bucket").orderBy("h", F.asc_nulls_last(F.col("row")[id_col]), "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.join(starts, ["key", "bucket"])
              .withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))))
    whole = F.floor(F.col("target") + 0.5).cast("long")

    def one_pass(copy):
        first = copy * F.col("source_size") + F.col("offset")
        taken = F.greatest(F.least(whole - first, F.col("size")), F.lit(0)).cast("long")
        return F.struct(copy.cast("int").alias("copy"), taken.alias("taken"),
                        due_time(F.col("place"), first / F.greatest(F.col("target"), F.lit(1.0)), schedules)
                        .alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)), one_pass), lambda p: p["taken"] > 0)
    total = F.aggregate(F.col("passes"), F.lit(0).cast("long"), lambda acc, p: acc + p["taken"])
    return (placed.withColumn("passes", passes)
            .select("row.*", "size", "source_size", F.col("target").cast("double").alias("target"),
                    total.alias("taken"), "passes"))


def by_position(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The plan with ``first_position``, range-sorted by it; documents that aren't taken come last."""
    return plan.withColumn("first_position", F.array_min("passes.position")) \
        .orderBy(F.asc_nulls_last("first_position"), F.asc_nulls_last(id_col))


def training_order(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per pass over a document, range-sorted by its training position."""
    kept = [c for c in plan.columns if c not in PLAN_COLUMNS]
    held = free_name("pass", kept)
    rows = plan.select(*kept, F.explode("passes").alias(held))
    names = {n: f"{n}_input" if n in kept else n for n in ("copy", "position", "taken")}
    renamed = [F.col(f"`{c}`").alias(names.get(c, c)) for c in kept]
    return (rows.select(*renamed, *[F.col(f"{held}.{n}").alias(n) for n in names])
            .orderBy("position", F.asc_nulls_last(id_col), "copy"))

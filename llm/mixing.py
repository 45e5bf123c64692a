"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same fractional number of times. The whole part is certain;
of the fractional parts two at a time are paired, and mass (probability times words) moves from one to
the other at random, keeping both expectations, until one is 0 or 1. One fraction at most is left of
each bucket; a reduction tree pairs those of 64 buckets at a time, until one is left of a source.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ddl, fresh, ranked, written

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3  # copies of a document at most
BUCKET = 4096  # documents that one pairing run goes through
FAN_IN = 64
SEED = 20
AT_ONCE = 1 << 16  # rows of a unit that are listed at once


def size_of(text: str = "text") -> Column:
    """Words of a text: runs of what is not ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for ``units(source, words)``; one row for each source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share all words; none gets
    more than ``most`` times its words, and what is over goes to the others by weight, until none is
    above. Each round caps the sources above the level so far, which only rises; all of it are sums over
    a table of sources, however many there are, and only sums reach the driver. Sums of whole numbers are
    exact, so reruns agree.
    """
    sums = units.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = ranked(sums, [F.col("source").isNull(), F.col("source")], "place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    t = t.select("source", "source_size", w.alias("w"), (most * F.col("source_size").cast("double")).alias("cap"))
    level, capped = 0.0, -1
    while True:
        over = F.col("w") * level > F.col("cap")
        full = F.sum(F.when(over, F.col("source_size").cast("decimal(38,0)")))
        some = t.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), full, F.sum(F.when(~over, F.col("w"))), F.count_if(over)).first()
        if some[3] == capped or not some[2]:
            break
        level, capped = (float(some[0]) - most * float(some[1] or 0)) / some[2], some[3]
    return t.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _uniform(seed: int, level: int, a, b) -> float:
    return (xxhash.xxh64_intdigest(f"{seed}|{level}|{a}|{b}") + 0.5) / 2**64


def pivot(rows: list[tuple[object, int, float]], seed: int = SEED, level: int = 0) -> list[float]:
    """New probabilities of ``(id, words, probability)`` in turn; at most one is neither 0 nor 1."""
    out, held = [p for _, _, p in rows], None
    for i, (name, words, p) in enumerate(rows):
        if not 0 < p < 1:
            continue
        if held is None:
            held = i
            continue
        h, (other, size, _) = held, rows[held]
        up = min((1 - out[h]) * size, p * words)  # mass that can go to the held one
        down = min(out[h] * size, (1 - p) * words)
        if _uniform(seed, level, other, name) * (up + down) < down:
            full, empty = (1 - out[h]) * size <= up, p * words <= up
            out[h], out[i] = 1.0 if full else out[h] + up / size, 0.0 if empty else p - up / words
        else:
            empty, full = out[h] * size <= down, (1 - p) * words <= down
            out[h], out[i] = 0.0 if empty else out[h] - down / size, 1.0 if full else p + down / words
        held = next((k for k in (h, i) if 0 < out[k] < 1), None)
    return out


def _round(seed: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        rows = list(zip(table["order"].to_pylist(), table["size"].to_pylist(), table["p"].to_pylist()))
        p = pivot(rows, seed, level)
        if last:  # what is left of a source stays by its own chance
            p = [float(_uniform(seed, -1, r[0], r[1]) < x) if 0 < x < 1 else x for r, x in zip(rows, p)]
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return run


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, n, source_size, target, copies``: how often the mix takes each document.

    Rows with equal id, source and size are one unit of ``n`` rows, which wants ``n`` times the copies
    of a row. The whole part is certain and only what is left, less than one copy, is rounded; ``share`` deals
    ``copies``, those of all rows together, to the rows evenly. Documents without words are never taken;
    null sources are one source, null ids are ids. Units are dealt to buckets by id and size, which tell the
    units of a source apart, so a bucket has about BUCKET of them, whatever the size of the source and
    however many ids are null. The same input gives the same mix.
    """
    units = docs.select("doc_id", "source", size_of().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    units = written(units.withColumn("words", F.col("n") * F.col("size")), "units")
    counts = units.groupBy("source").agg(F.ceil(F.count("*") / BUCKET).alias("buckets")).withColumnRenamed("source", "named")
    goal = targets(units, weights).withColumn("group", F.xxhash64("source", F.lit(seed)))
    goal = written(goal.join(counts, goal["source"].eqNullSafe(counts["named"])).drop("source"), "targets")
    rows = units.join(goal, units["source"].eqNullSafe(goal["named"])).drop("named")
    rate = F.when(F.col("words") > 0, F.col("n") * (F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)).withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), "buckets"))
    most = goal.agg(F.max("buckets")).first()[0] or 1
    columns = ["doc_id", "source", "size", "n", "source_size", "target", "group", "bucket", "order", "whole", "p"]
    rows, done, level = rows.select(*columns), None, 0
    kind = ", ".join(f"`{c}` {ddl(rows, c)}" for c in columns)
    while True:
        now = written(rows.groupBy("group", "source", "bucket").applyInArrow(_round(seed, level, most == 1), kind), "rounded")
        over = now.where("p = 0 or p = 1")
        done = over if done is None else done.unionByName(over)
        if most == 1:
            break
        rows = now.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1
    return done.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.col("p")).cast("bigint").alias("copies"))


def share(copies: str | Column, n: str | Column, place: str | Column) -> Column:
    """The copies of the row at ``place`` (from 0) of ``n`` rows that have ``copies`` together."""
    copies, n, place = (F.col(x) if isinstance(x, str) else x for x in (copies, n, place))
    return (F.floor(copies / n) + (place < copies % n).cast("bigint")).cast("bigint")


def taken(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document."""
    units = copies(docs).withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(AT_ONCE))))
    rows = units.withColumn("place", F.explode(F.sequence("from", F.least(F.col("from") + AT_ONCE, "n") - 1)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * share("copies", "n", "place")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken; columns as they came.

    Of rows with equal id, source and size, those of lesser text hash get a copy more where copies don't come out
    even. Such rows are numbered by a range sort over all of them.
    """
    size, name, source, same, n, times, place, first, each, *own = fresh(
        docs.columns, "size", "name", "from", "words", "n", "times", "place", "first", "each", "its_name", "its_source", "its_size")
    plan = copies(docs).where("copies > 0").select(
        F.col("doc_id").alias(name), F.col("source").alias(source), F.col("size").alias(same), F.col("n").alias(n), F.col("copies").alias(times))
    at = F.col("doc_id").eqNullSafe(F.col(name)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(size) == F.col(same))
    rows = docs.withColumn(size, size_of())
    unit = [name, source, same]
    single = rows.join(plan.where(F.col(n) == 1), at).withColumn(place, F.lit(0).cast("bigint"))
    many = written(plan.where(F.col(n) > 1), "repeated")  # small as a rule, and then documents aren't shuffled for it
    several = ranked(rows.join(many, at), [*map(F.col, unit), F.xxhash64("text"), F.xxhash64(*docs.columns), F.rand(SEED)], place)
    least = written(several.groupBy(*unit).agg(F.min(place).alias(first)), "first").toDF(*own, first)
    is_of = F.col(name).eqNullSafe(F.col(own[0])) & F.col(source).eqNullSafe(F.col(own[1])) & (F.col(same) == F.col(own[2]))
    several = several.join(least, is_of).withColumn(place, F.col(place) - F.col(first)).select(*single.columns)
    rows = single.unionByName(several).withColumn(times, share(times, n, place)).where(F.col(times) > 0)
    return rows.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)

"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's words are laid out in a seeded order, pass after pass, and cut into blocks of equal size.  Sainte-Laguë
gives each source an integer number of blocks, by highest quotients target / (2k + 1); because the method is house
monotone, running it to the end of each shard gives integer quotas per shard that add up.  Each shard in turn takes
its quota of a source's next blocks; since the order is seeded, so is the choice.  A document is thus taken for the
shards that its blocks fall to, whole but for the one at the end of its source's last block.

Positions come from two levels of sums (hash buckets within a source, then rows within a bucket), so the rows
of a large source never meet in one task.  Only one row per source reaches the driver, where quotas are made.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import WORD_SPACE, durable

#: Sources are a configured list, so quotas are made on the driver; more than this is an error, not a cut.
MAX_SOURCES = 200_000
ROWS_PER_BUCKET = 512
#: Words of a block, and shards of a mix.
BLOCK, SHARDS = 4, 16


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_SPACE), "")), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; what is above goes to the others by weight."""
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = Fraction(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > most * sizes[i] * w]
        if not full:
            for i in open_:
                targets[i] = float(left * weights[i] / w)
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            open_.remove(i)
        left -= sum(most * sizes[i] for i in full)
    return targets


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2k + 1); ties go to the earlier party.

    Starts from the rounded fair shares, gives back the lowest quotients that are too many and hands out the highest
    that are missing, so the number of steps depends on the parties and not on the seats.
    """
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    out = [int(seats * v / total + 0.5) for v in votes]
    while sum(out) > seats:  # give back the lowest quotients that have won
        excess = sum(out) - seats
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if s]
        heapq.heapify(heap)
        for _ in range(excess):
            q, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * out[-i] - 1), i))
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if v]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def shard_quotas(votes: list[float], seats: int, shards: int) -> list[list[int]]:
    """For each shard, the blocks of each source; shards are of equal size to within a block."""
    ends = [sainte_lague(votes, seats * (k + 1) // shards) for k in range(shards)]
    return [[b - a for a, b in zip(ends[k - 1] if k else [0] * len(votes), ends[k], strict=True)] for k in range(shards)]


@dataclass
class Mix:
    """rows: id, size, source_size, target, taken, shards, text_hash.  quotas: shard, source, blocks."""

    rows: DataFrame
    quotas: DataFrame


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, shards: int = SHARDS, seed: int = 42, most: int = 3) -> Mix:
    """Takes blocks of words from each source until it has its share.

    Sources in code point order, null last, weigh as `cycle` repeats.  Targets share the total size and stop at
    `most` times a source's size.  A document's taken words are its overlap with the blocks its source takes,
    counted as often as they are taken, so never above `most` times its size; shards says how many of them each shard
    has, as shard:words with commas, and text_hash tells rows with one id apart.  A null text has size 0; a null id
    is a row like any other; rows with equal ids and texts are laid out side by side, in either order with the
    same sum.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = durable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text).alias("text_hash")))
    stats = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [int(r["s"]) for r in stats]
    targets = capped_targets(sizes, [cycle[i % len(cycle)] for i in range(len(stats))], most)
    per_shard = shard_quotas(targets, sum(sizes) // block, shards) if stats else []
    rows = []
    for i, r in enumerate(stats):
        ends = [min(block * b, most * sizes[i]) for b in accumulate(q[i] for q in per_shard)]
        rows.append((r["source"], sizes[i], targets[i], ends, max(1, int(r["n"]) // ROWS_PER_BUCKET)))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, ends array<long>, buckets long")
    quotas = spark.createDataFrame([(k, r["source"], q[i]) for k, q in enumerate(per_shard) for i, r in enumerate(stats)], "shard int, source string, blocks long")

    known = F.broadcast(plan) if len(rows) <= 10_000 else plan  # a row has about 300 bytes, so 3 MB at most
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    placed = sized.withColumn("place", place).alias("d").join(known.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("id", "size", "text_hash", "place", "d.source", *plan.columns[1:])
    # buckets are ranges of places, so a source's order is that of its places
    placed = placed.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("place", "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    laid = within.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("before") + F.col("within"))

    def words(end: Column, k: Column) -> Column:
        """Of a document, those between the end of the shard before and this end, over all passes."""
        first = F.when(k > 0, F.get("ends", k - 1)).otherwise(F.lit(0))
        passes = [F.col("start") + p * F.col("source_size") for p in range(most)]
        return sum((F.greatest(F.least(at + F.col("size"), end) - F.greatest(at, first), F.lit(0)) for at in passes), F.lit(0)).cast("long")

    by_shard = laid.withColumn("by_shard", F.transform("ends", words))
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.filter(F.transform("by_shard", lambda x, k: F.when(x > 0, F.concat_ws(":", k.cast("string"), x.cast("string")))), lambda x: x.isNotNull())
    return Mix(by_shard.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), F.array_join(some, ",").alias("shards"), "text_hash"), quotas)

"""Candidate pairs by IDF-weighted sparse cosine.

Keys that are too rare or too common are cut before the join, so a key brings at most cap**2 / 4 pairs.  All pairs are
scored, block against block of records within a task, and only those that can be among the best of either side leave
it; these are ranked from both sides.  Weights are doubles; scores are rounded before they are ranked, and ties go to
the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.operators.ranking import rank_within
from affinis.sources.shared import stored

DIGITS = 6
#: S1 records of a block: from this many on there are several, up to BLOCKS, which then grow up to the larger size.
LEAST_BLOCK, BLOCKS, MOST_BLOCK = 1 << 12, 8, 1 << 16
#: Other records of a block, at most about.
OTHERS = 1 << 17
#: Products of weights, and sums, that a task holds at once, about.
PRODUCTS, SUMS = 1 << 21, 1 << 23
BY_RECORD = ("country", "src", "entity_id")


def caps(word: int, pair: int) -> dict[str, int]:
    """Largest document frequency by kind of key."""
    return {"nu": word, "au": word, "np": pair, "ab": pair, "sk": pair}


def key_frequency(keys: DataFrame) -> DataFrame:
    """country, kind, key, df over all sources of a country."""
    return keys.groupBy("country", "kind", "key").agg(F.count("*").alias("df"))


def _cap_of(kind: Column, most: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))])[kind]


def key_idf(keys: DataFrame, records: DataFrame, most: dict[str, int]) -> DataFrame:
    """country, kind, key, df, idf for keys in two records or more and in no more than the kind's cap.

    idf = ln((records of the country + 1) / (df + 1)).
    """
    docs = records.groupBy("country").agg(F.count("*").alias("n_docs"))
    cut = key_frequency(keys).filter((F.col("df") >= 2) & (F.col("df") <= _cap_of(F.col("kind"), most)))
    return cut.join(docs, "country").withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1))).drop("n_docs")


def weighted_keys(keys: DataFrame, records: DataFrame, most: dict[str, int]) -> DataFrame:
    """keys with weight, of norm 1 over all kinds of a record."""
    kept = keys.join(key_idf(keys, records, most), ["country", "kind", "key"])
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy(*BY_RECORD)))
    return kept.withColumn("weight", F.when(norm > 0, F.col("idf") / norm).otherwise(0.0)).select(*BY_RECORD, "kind", "key", "weight")


def scored_pairs(weighted: DataFrame) -> DataFrame:
    """country, s1, r, src, score of all pairs of source 1 with another source that share a key."""
    left = weighted.filter("src = 1").select("country", "kind", "key", F.col("entity_id").alias("s1"), F.col("weight").alias("w1"))
    right = weighted.filter("src != 1").select("country", "kind", "key", F.col("entity_id").alias("r"), "src", F.col("weight").alias("w2"))
    score = F.round(F.sum(F.col("w1") * F.col("w2")), DIGITS)
    return left.join(right, ["country", "kind", "key"]).groupBy("country", "s1", "r", "src").agg(score.alias("score")).filter("score > 0")


def near_pairs(weighted: DataFrame, k: int, rev_m: int) -> DataFrame:
    """The rows of scored_pairs that may be among the best k of an S1 record and source, or the best rev_m of a record.

    All pairs are scored.  Each block of S1 records meets each block of the other records of its country in one task,
    which keeps the best of either side there; ranks below k and rev_m among the rows returned are those among all.
    """
    one, key = F.col("src") == 1, ["country", "kind", "key"]
    met = weighted.groupBy(*key).agg(F.bool_or(one).alias("_a"), F.bool_or(~one).alias("_b")).filter("_a and _b")
    numbers = stored(met.select(*key, F.monotonically_increasing_id().alias("number")), "numbers")
    held = weighted.join(numbers, key).groupBy(*BY_RECORD).agg(F.collect_list(F.struct("number", "weight")).alias("_w"))
    vectors = stored(held.select(*BY_RECORD, F.col("_w.number").alias("numbers"), F.col("_w.weight").alias("weights")), "vectors")
    n1, n2 = F.count_if(one), F.count_if(~one)
    blocks = F.least(F.ceil(n1 / LEAST_BLOCK), F.greatest(F.lit(BLOCKS), F.ceil(n1 / MOST_BLOCK)))
    sizes = vectors.groupBy("country").agg(blocks.alias("n_l"), F.ceil(n2 / OTHERS).alias("n_r")).filter("n_l > 0 and n_r > 0")  # one row a country
    parts = 2 * int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sided, by = vectors.join(sizes, "country"), ["country", "_l", "_r"]

    def side(rows: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        dealt = rows.withColumns({own: F.pmod(F.xxhash64("entity_id"), F.col(n_own)), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))})
        fresh = [F.col(c).alias(c) for c in (*by, "entity_id", "numbers", "weights")]  # both sides come of one table
        return dealt.select(*fresh, F.col("src").cast("long").alias("src")).repartition(parts, *by)  # a number asked for stays

    left, right = side(sided.filter(one), "_l", "n_l", "_r", "n_r"), side(sided.filter(~one), "_r", "n_r", "_l", "n_l")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best_of_blocks(k, rev_m), "country string, s1 string, r string, src long, score double")
    return found.withColumn("src", F.col("src").cast(weighted.schema["src"].dataType))


def _vectors(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by id, and numbers and weights of all with the row of each."""
    rows = rows.take(pc.sort_indices(rows.column("entity_id")))
    numbers, weights = (rows.column(c).combine_chunks() for c in ("numbers", "weights"))
    row = np.repeat(np.arange(len(rows)), numbers.value_lengths().to_numpy())
    return rows, row, numbers.flatten().to_numpy(), weights.flatten().to_numpy()


def _first(group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows of each group; groups lie together."""
    start = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    return np.flatnonzero(np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group)))) < most)


def _sums(left: tuple, right: tuple, n_left: int, n_right: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, score in steps of the last digit) of all pairs with a score above 0, by runs of left rows."""
    (l_row, l_number, l_weight), (r_row, number, r_weight) = left, right
    order = np.argsort(number, kind="stable")
    r_row, number, r_weight = r_row[order], number[order], r_weight[order]
    start = np.searchsorted(number, l_number)
    size = np.searchsorted(number, l_number, "right") - start
    borders = np.searchsorted(l_row, np.arange(n_left + 1))
    so_far = np.concatenate([[0], np.cumsum(size)])[borders]
    rows = max(1, min(n_left, SUMS // n_right))
    total, place = np.zeros(rows * n_right), np.zeros(rows * n_right, np.int64)
    lo = 0
    while lo < n_left:
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(so_far, so_far[lo] + PRODUCTS, "right")) - 1))
        own = slice(borders[lo], borders[hi])
        n = size[own]
        at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat((l_row[own] - lo) * n_right, n) + r_row[at]
        np.add.at(total, cell, np.repeat(l_weight[own], n) * r_weight[at])
        place[cell] = np.arange(len(cell))
        cell = cell[place[cell] == np.arange(len(cell))]  # each once
        score = np.floor(total[cell] * 10**DIGITS + 0.5).astype(np.int64)
        total[cell] = 0
        cell, score = cell[score > 0], score[score > 0]
        yield cell // n_right + lo, cell % n_right, score
        lo = hi


def _best_of_blocks(k: int, rev_m: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n_left, n_right = len(left), len(right)
        names, kinds = ["country", "s1", "r", "src", "score"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        if not n_left or not n_right:
            return pa.table([pa.array([], t) for t in kinds], names)
        (left, *ours), (right, *theirs) = _vectors(left), _vectors(right)
        src = np.unique(right.column("src").to_numpy(), return_inverse=True)[1]
        found = [[np.zeros(0, np.int64)] * 3]
        rev: list[list[np.ndarray]] = []
        worst, many = np.full(n_right, np.iinfo(np.int64).max), 0  # of a record's best so far
        for row, r, score in _sums(ours, theirs, n_left, n_right):
            if not len(row):
                continue
            most, bits = int(score.max()), int(n_right).bit_length()
            group = (row - row.min()) * (src.max() + 1) + src[r]
            wide = bits + most.bit_length()
            if int(group.max()).bit_length() + wide < 63:
                order = np.sort(group << wide | (most - score) << bits | r)
                order = order[_first(order >> wide, k)]
                own = order >> wide
                found.append([own // (src.max() + 1) + row.min(), order & ((1 << bits) - 1), most - (order >> bits & ((1 << most.bit_length()) - 1))])
            else:
                order = np.lexsort((r, -score, group))
                order = order[_first(group[order], k)]
                found.append([row[order], r[order], score[order]])
            if rev_m:
                better = -score * (1 << 20) + row  # blocks have fewer rows; falling score, rising id
                some = np.flatnonzero(better < worst[r])
                rev.append([r[some], better[some]])
                many += len(some)
                if many > PRODUCTS:
                    rev = [_best_rev(rev, rev_m, worst)]
                    many = len(rev[0][0])
        if rev:
            r, better = _best_rev(rev, rev_m, worst)
            score = -(better >> 20)
            found.append([better + (score << 20), r, score])
        row, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
        once = np.unique(row * n_right + r, return_index=True)[1]
        row, r, score = row[once], r[once], score[once]
        sides = [left.column("entity_id").take(pa.array(row)), *(right.column(c).take(pa.array(r)) for c in ("entity_id", "src"))]
        return pa.table([pa.array([key[0].as_py()] * len(row), pa.string()), *sides, pa.array(score / 10**DIGITS)], names)

    return run


def _best_rev(held: list[list[np.ndarray]], rev_m: int, worst: np.ndarray) -> list[np.ndarray]:
    """The best of each record; its last place is from now on to be beaten."""
    r, better = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((better, r))
    r, better = r[order], better[order]
    kept = _first(r, rev_m)
    r, better = r[kept], better[kept]
    last = np.flatnonzero(r[rev_m - 1 :] == r[: max(len(r) - rev_m + 1, 0)])
    worst[r[last]] = better[last + rev_m - 1]
    return [r, better]


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Adds fwd_rank (among one source of an S1 record) and rev_rank (among the S1 records of a record), from 0."""
    return pairs.withColumns({"fwd_rank": rank_within(("country", "s1", "src"), "score", "r"), "rev_rank": rank_within(("country", "r"), "score", "s1")})


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The best k records of each other source for each S1 record."""
    return pairs.withColumn("fwd_rank", rank_within(("country", "s1", "src"), "score", "r")).filter(F.col("fwd_rank") < k)


def bidirectional(pairs: DataFrame, k: int, rev_m: int) -> DataFrame:
    """Pairs found forward (best k) or in reverse (best rev_m), with is_fwd."""
    found = ranked_pairs(pairs).withColumn("is_fwd", F.col("fwd_rank") < k)
    return found.filter(F.col("is_fwd") | (F.col("rev_rank") < rev_m))


def candidates(pairs: DataFrame, k: int, m: int | None, rev_m: int) -> DataFrame:
    """Forward pairs whose rank among the forward pairs of their record is below m, and reverse pairs."""
    found = bidirectional(pairs, k, rev_m).withColumn("among", rank_within(("country", "r", "is_fwd"), "score", "s1"))
    keep = (F.col("is_fwd") & (F.col("among") < m if m is not None else F.lit(True))) | (F.col("rev_rank") < rev_m)
    return found.filter(keep).select("country", "s1", "r", "src", "score")


def filter_candidates(ranked: DataFrame, k: int, m: int | None) -> DataFrame:
    """Pairs with fwd_rank below k; of these, the best m for each record."""
    kept = ranked.filter(F.col("fwd_rank") < k)
    if m is None:
        return kept
    return kept.withColumn("_again", rank_within(("country", "r"), "score", "s1")).filter(F.col("_again") < m).drop("_again")


def pair_score(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """Score of given pairs (country, s1, r), 0 where they share no key."""
    left = weighted.filter("src = 1").select("country", F.col("entity_id").alias("s1"), "kind", "key", F.col("weight").alias("w1"))
    right = weighted.filter("src != 1").select("country", F.col("entity_id").alias("r"), "kind", "key", F.col("weight").alias("w2"))
    hit = pairs.select("country", "s1", "r").join(left, ["country", "s1"]).join(right, ["country", "r", "kind", "key"])
    score = hit.groupBy("country", "s1", "r").agg(F.round(F.sum(F.col("w1") * F.col("w2")), DIGITS).alias("score"))
    return pairs.join(score, ["country", "s1", "r"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

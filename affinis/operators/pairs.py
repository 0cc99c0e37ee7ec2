"""Features of a pair of records: token sets, string similarity, house numbers, name frequency.

sides(records) gives the columns of one record once; a pair joins them twice and no text is tokenised per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions import crossed
from affinis.functions import similarity as sim
from affinis.functions.text import address_numbers, name_skeleton, norm_name, numbers

#: Numbers of fewer digits are compared by value.
DIGITS = 12


def sides(tokenised: DataFrame, *more: str | Column) -> DataFrame:
    """country, src, entity_id and the columns that pair features need."""
    return tokenised.select("country", "src", "entity_id", *more, F.col("name_tokens").alias("name"), F.col("addr_tokens").alias("addr"), name_skeleton(F.col("name_tokens")).alias("skel"), numbers(F.col("addr_tokens")).alias("nums"))


def with_sides(pairs: DataFrame, tokenised: DataFrame) -> DataFrame:
    """pairs (country, s1, r) with name1, name2, addr1, ... of both records."""
    one, cols = sides(tokenised), ("name", "addr", "skel", "nums")
    left = one.filter("src = 1").select("country", F.col("entity_id").alias("s1"), *[F.col(c).alias(f"{c}1") for c in cols])
    right = one.filter("src != 1").select("country", F.col("entity_id").alias("r"), *[F.col(c).alias(f"{c}2") for c in cols])
    return pairs.join(left, ["country", "s1"]).join(right, ["country", "r"])


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    return _share(_overlap(a, b), F.size(F.array_union(a, b)))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def set_features(sided: DataFrame) -> DataFrame:
    """Counts, shares and flags of the two token lists, all built in."""
    n1, n2, a1, a2 = (F.col(c) for c in ("name1", "name2", "addr1", "addr2"))
    q1, q2 = F.array_join(n1, ""), F.array_join(n2, "")
    f1, f2 = F.get("nums1", F.lit(0)), F.get("nums2", F.lit(0))
    short, long = F.when(F.length(q1) <= F.length(q2), q1).otherwise(q2), F.when(F.length(q1) <= F.length(q2), q2).otherwise(q1)
    distinct = lambda c: F.size(F.array_distinct(c))
    joined = norm_name(n2)
    return sided.withColumns(
        {
            "name_jacc": jaccard(n1, n2),
            "name_contain": _share(_overlap(n1, n2), F.least(distinct(n1), distinct(n2))),
            "sq_eq": _flag((q1 != "") & (q1 == q2)),
            "sq_contain": _flag((F.length(short) >= 4) & F.contains(long, short)),
            "n_tok1": F.size(n1).cast("double"),
            "n_tok2": F.size(n2).cast("double"),
            "name2_nonascii": _flag(F.length(joined) != F.octet_length(joined)),
            "addr_jacc": jaccard(a1, a2),
            "addr_contain2": _share(_overlap(a1, a2), distinct(a2)),
            "addr1_empty": _flag(F.size(a1) == 0),
            "addr2_empty": _flag(F.size(a2) == 0),
            "num_shared": _overlap(F.col("nums1"), F.col("nums2")),
            "first_num_eq": _flag(f1 == f2),
            "first_num_prefix": _flag((f1 != f2) & (f1.startswith(f2) | f2.startswith(f1))),
            "a_tok1": F.size(a1).cast("double"),
            "a_tok2": F.size(a2).cast("double"),
            "name_in_addr2": _share(_overlap(n1, a2), distinct(n1)),
            "sk_jacc": jaccard(F.col("skel1"), F.col("skel2")),
        }
    )


def similarity_features(sided: DataFrame, dealt: bool = False) -> DataFrame:
    """The similarities that Spark has no function for, on Arrow batches.

    They cost far more than the bytes of a pair suggest, so the pairs are dealt over all shuffle partitions first, unless
    they are dealt already; adaptive execution does not undo a number that is asked for.
    """
    if not dealt:
        sided = sided.repartition(int(sided.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = lambda c, by=" ": F.array_join(c, by)
    s1, s2, b1, b2, k1, k2 = (text(c) for c in ("name1", "name2", "addr1", "addr2", "skel1", "skel2"))
    ordered = [text(F.array_sort(c)) for c in ("name1", "name2")]
    return sided.withColumns(
        {
            "name_ratio": sim.indel_ratio(s1, s2),
            "name_tsort": sim.indel_ratio(*ordered),
            "name_tset": sim.set_ratio(s1, s2),
            "name_partial": sim.part_ratio(s1, s2),
            "name_jw": sim.winkler(s1, s2),
            "sq_ratio": sim.indel_ratio(text("name1", ""), text("name2", "")),
            "addr_ratio": sim.indel_ratio(b1, b2),
            "addr_tset": sim.set_ratio(b1, b2),
            "addr_partial": sim.part_ratio(b1, b2),
            "sk_ratio": sim.indel_ratio(k1, k2),
            "sk_tset": sim.set_ratio(k1, k2),
        }
    )


# Names of the features, by how they are computed.
SET_FEATURES = ["name_jacc", "name_contain", "sq_eq", "sq_contain", "n_tok1", "n_tok2", "name2_nonascii", "addr_jacc", "addr_contain2", "addr1_empty", "addr2_empty", "num_shared", "first_num_eq", "first_num_prefix", "a_tok1", "a_tok2", "name_in_addr2", "sk_jacc"]
SIMILARITY_FEATURES = ["name_ratio", "name_tsort", "name_tset", "name_partial", "name_jw", "sq_ratio", "addr_ratio", "addr_tset", "addr_partial", "sk_ratio", "sk_tset"]
NUMBER_FEATURES = ["r_nums", "s_nums", "n_exact", "n_affix", "n_near1", "n_other", "frac_other", "log_min_diff_other", "log_first_absdiff", "first_rel"]
FREQUENCY_FEATURES = ["s1name_in_s1", "rname_in_s1", "rname_in_r", "s1name_in_r", "same_norm_name"]


# --- blocks against blocks

#: S1 and other records in a block, about.
LEFT, RIGHT = 1 << 9, 1 << 10
#: Pairs of addresses that are compared before rows leave, about, and pairs in rows that leave together.
POOLED, SENT = 1 << 17, 1 << 14
BLOCKED = ["name", "skel", "addr", "nums"]


def blocked(own: DataFrame, *by: str) -> DataFrame:
    """left and right: lists of S1 and other records that agree in by, so that each pair of them is in one row's lists.

    own: src, by, entity_id and the columns that sides gives.  Records are dealt over blocks by their ids; a block goes to
    each of the other side's, so a value of many records makes many rows of bounded size and no pair is a row here.
    """
    parts = 2 * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = (F.col("src") == 1).cast("long")
    n = own.groupBy(*by).agg(F.sum(one).alias("_a"), F.sum(1 - one).alias("_b")).filter("_a > 0 and _b > 0")
    blocks = n.select(*by, F.ceil(F.col("_a") / LEFT).alias("_n"), F.ceil(F.col("_b") / RIGHT).alias("_m"))
    each = own.select(*by, "src", "entity_id", *[F.array_join(c, " ").alias(c) for c in BLOCKED]).join(blocks, [*by])

    def side(name: str, which: str, mine: str, its: str, place: str, other: str) -> DataFrame:
        dealt = each.filter(which).withColumn(place, F.pmod(F.xxhash64("entity_id"), F.col(mine)))
        lists = dealt.groupBy(*by, place, its).agg(F.collect_list(F.struct("entity_id", *BLOCKED)).alias(name))
        return lists.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(its) - 1))).drop(its).repartition(parts, *by, "_i", "_j")

    left, right = side("left", "src = 1", "_n", "_m", "_i", "_j"), side("right", "src != 1", "_m", "_n", "_j", "_i")
    return left.join(right.hint("merge"), [*by, "_i", "_j"]).select("left", "right")


def block_features(blocks: DataFrame) -> DataFrame:
    """s1, r, SET_FEATURES and SIMILARITY_FEATURES (to six digits) of each pair of a row's lists, as set_features and similarity_features have them.

    Names, addresses and pairs of different addresses are described once for a row's lists.
    """
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")  # a row is large
    return blocks.mapInArrow(_block_features, "s1 string, r string, " + ", ".join(f"{c} double" for c in SET_FEATURES + SIMILARITY_FEATURES))


def _block_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, many = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("left", "right")), strict=True):
            held.append(row)
            many += len(row[0]) * len(row[1])
            if many >= POOLED:
                yield from _pool(held)
                held, many = [], 0
    if held:
        yield from _pool(held)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six digits as Spark rounds: halves of the shortest decimal away from 0."""
    scaled = x * 1e6
    out = np.rint(scaled) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _words(text: str) -> list[str]:
    return text.split(" ") if text else []


def _both(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Distinct words of both, of one and of the other."""
    a, b = set(a), set(b)
    return len(a & b), len(a), len(b)


def _name_features(keys: list[tuple[str, str, str, str]]) -> dict[str, np.ndarray]:
    """keys: name and skeleton of one record, then of the other."""
    s1, k1, s2, k2 = (list(c) for c in zip(*keys, strict=True))
    n1, n2, w1, w2 = ([_words(t) for t in c] for c in (s1, s2, k1, k2))
    q1, q2, o1, o2 = ([by.join(f(t)) for t in c] for by, f, c in (("", list, n1), ("", list, n2), (" ", sorted, n1), (" ", sorted, n2)))
    names, skels = ([_both(a, b) for a, b in zip(x, y, strict=True)] for x, y in ((n1, n2), (w1, w2)))
    short = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(q1, q2, strict=True)]
    jacc = lambda c: [both / max(a + b - both, 1) for both, a, b in c]
    out = {
        "name_jacc": jacc(names),
        "name_contain": [both / max(min(a, b), 1) for both, a, b in names],
        "sq_eq": [a != "" and a == b for a, b in zip(q1, q2, strict=True)],
        "sq_contain": [len(a) >= 4 and a in b for a, b in short],
        "n_tok1": [len(x) for x in n1],
        "n_tok2": [len(x) for x in n2],
        "name2_nonascii": [not x.isascii() for x in s2],
        "sk_jacc": jacc(skels),
    }
    like = {
        "name_ratio": sim.ratios(s1, s2),
        "name_tsort": sim.ratios(o1, o2),
        "name_tset": sim.token_set_ratios(s1, s2),
        "name_partial": sim.partial_ratios(s1, s2),
        "name_jw": sim.jaro_winklers(s1, s2),
        "sq_ratio": sim.ratios(q1, q2),
        "sk_ratio": sim.ratios(k1, k2),
        "sk_tset": sim.token_set_ratios(k1, k2),
    }
    return {k: np.array(v, np.float64) for k, v in out.items()} | {k: _rounded(v) for k, v in like.items()}


def _numbered(values: list, known: dict) -> np.ndarray:
    """Numbers of values, which known has or gets."""
    return np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, len(values))


def _pool(rows: list[tuple[list[dict], list[dict]]]) -> Iterator[pa.RecordBatch]:
    """Rows of the pairs of some lists."""
    ids: tuple[list, list] = [], []
    texts, numbers, names, inner = {}, {}, {}, {}  # by address, its nums, by names and skeletons, by name and other address
    one, other, same, alike, inside, a, b, done = [], [], [], [], [], [], [], 0
    for left, right in rows:
        n, m = len(left), len(right)
        one.append(np.repeat(np.arange(n), m) + len(ids[0]))
        other.append(np.tile(np.arange(m), n) + len(ids[1]))
        at = [_numbered([r["addr"] for r in side], texts) for side in (left, right)]
        for own, side in zip(ids, (left, right), strict=True):
            own += [r["entity_id"] for r in side]
            numbers.update((r["addr"], r["nums"]) for r in side)
        (x, i), (y, j) = (np.unique(t, return_inverse=True) for t in at)
        a.append(np.repeat(x, len(y)))
        b.append(np.tile(y, len(x)))
        same.append((i[:, None] * len(y) + j).ravel() + done)
        done += len(x) * len(y)
        kinds: tuple[dict, dict] = {}, {}
        of = [_numbered([(r["name"], r["skel"]) for r in side], k) for side, k in zip((left, right), kinds, strict=True)]
        pairs = _numbered([p + q for p in kinds[0] for q in kinds[1]], names).reshape(len(kinds[0]), -1)
        alike.append(pairs[of[0][:, None], of[1]].ravel())
        every = list(texts)
        found = _numbered([(p[0], every[k]) for p in kinds[0] for k in y], inner).reshape(len(kinds[0]), -1)
        inside.append(found[of[0][:, None], j].ravel())
    one, other, same, alike, inside, a, b = (np.concatenate(p) for p in (one, other, same, alike, inside, a, b))

    every = list(texts)
    words = [_words(t) for t in every]
    size, distinct = (np.array([len(f(w)) for w in words], np.float64) for f in (list, set))
    nums = [_words(numbers[t]) for t in every]
    first = [w[0] if w else None for w in nums]
    by_pair = {k: np.empty(len(a)) for k in ("addr_ratio", "addr_tset", "addr_partial", "addr_jacc", "addr_contain2", "num_shared")}
    for at, got in crossed.compare(every, a, b, set().union(*nums)):
        p, q = distinct.take(a[at]), distinct.take(b[at])
        values = got.ratio, got.tset, got.partial, got.shared / np.maximum(p + q - got.shared, 1), got.shared / np.maximum(q, 1), got.numbers
        for k, v in zip(by_pair, values, strict=True):
            by_pair[k][at] = _rounded(v) if k in SIMILARITY_FEATURES else v
    known: dict = {}
    number = _numbered(first, known)
    lead = list(known)
    starts = np.array([[x is not None and y is not None and x != y and (x.startswith(y) or y.startswith(x)) for y in lead] for x in lead], np.float64) if len(lead) <= 1 << 10 else None
    p, q = number.take(a), number.take(b)
    by_pair["first_num_eq"] = ((p == q) & np.array([x is not None for x in lead]).take(p)).astype(np.float64)
    if starts is not None:
        by_pair["first_num_prefix"] = starts[p, q]
    else:
        some, back = np.unique(p * len(lead) + q, return_inverse=True)
        both = [(lead[k // len(lead)], lead[k % len(lead)]) for k in some]
        by_pair["first_num_prefix"] = np.array([x is not None and y is not None and x != y and (x.startswith(y) or y.startswith(x)) for x, y in both], np.float64).take(back)
    by_name = _name_features(list(names))
    shares = [_both(_words(name), words[texts[addr]]) for name, addr in inner]
    within = np.array([both / max(n, 1) for both, n, _ in shares])
    ends = {"addr1_empty": (a, size == 0), "addr2_empty": (b, size == 0), "a_tok1": (a, size), "a_tok2": (b, size)}
    by_pair |= {k: v.astype(np.float64).take(of) for k, (of, v) in ends.items()}
    ids = [pa.array(x, pa.string()) for x in ids]
    for lo in range(0, len(one), SENT):
        at = slice(lo, lo + SENT)
        columns = {k: v.take(alike[at]) for k, v in by_name.items()} | {k: v.take(same[at]) for k, v in by_pair.items()} | {"name_in_addr2": within.take(inside[at])}
        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(one[at])), ids[1].take(pa.array(other[at])), *(pa.array(columns[c]) for c in SET_FEATURES + SIMILARITY_FEATURES)], ["s1", "r", *SET_FEATURES, *SIMILARITY_FEATURES])


# --- house numbers

EXACT, AFFIX, NEAR, OTHER = range(4)


def _value(x: Column) -> Column:
    """Value of a short number, null for a long one."""
    return F.when(F.length(x) < DIGITS, x.try_cast("long"))


def _distance(x: Column, others: Column) -> Column:
    """Smallest difference from the short numbers among others; null if there is none."""
    return F.array_min(F.filter(F.transform(others, lambda y: F.abs(_value(x) - _value(y))), lambda d: d.isNotNull()))


def _affix(x: Column, y: Column) -> Column:
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (F.length(short) >= 2) & (long.startswith(short) | long.endswith(short))


def relation(x: Column, others: Column) -> Column:
    """How a number stands to a list: the first that holds of the same, an affix of one, next to one, other."""
    near = F.coalesce(_distance(x, others) <= 1, F.lit(False))
    return F.when(F.array_contains(others, x), EXACT).when(F.exists(others, lambda y: _affix(x, y)), AFFIX).when(near, NEAR).otherwise(OTHER)


def house_number_features(sided: DataFrame) -> DataFrame:
    """Relations of the other record's numbers to those of the S1 record; nums1 and nums2 are token lists."""
    lists = sided.withColumns({"_a": address_numbers(F.col("nums1")), "_b": address_numbers(F.col("nums2"))})
    rel = lists.withColumn("_rel", F.transform("_b", lambda x: F.struct(relation(x, F.col("_a")).alias("r"), _distance(x, F.col("_a")).alias("d"))))
    count = lambda kind: F.size(F.filter("_rel", lambda x: x["r"] == kind)).cast("double")
    least = F.array_min(F.transform(F.filter("_rel", lambda x: (x["r"] == OTHER) & x["d"].isNotNull()), lambda x: x["d"]))
    a0, b0 = F.get("_a", F.lit(0)), F.get("_b", F.lit(0))
    gap = F.abs(_value(a0) - _value(b0))
    both = (F.size("_a") > 0) & (F.size("_b") > 0)
    return rel.withColumns(
        {
            "r_nums": F.size("_b").cast("double"),
            "s_nums": F.size("_a").cast("double"),
            "n_exact": count(EXACT),
            "n_affix": count(AFFIX),
            "n_near1": count(NEAR),
            "n_other": count(OTHER),
            "frac_other": _share(count(OTHER), F.size("_b")),
            "log_min_diff_other": F.coalesce(F.log1p(least.cast("double")), F.lit(-1.0)),
            "log_first_absdiff": F.coalesce(F.log1p(gap.cast("double")), F.lit(-1.0)),
            "first_rel": F.when(both, relation(b0, F.array(a0))).otherwise(-1).cast("double"),
        }
    ).drop("_a", "_b", "_rel")


# --- name frequency


def name_frequency(tokenised: DataFrame) -> DataFrame:
    """country, name, n_s1 and n_rec: how many records of source 1 and of the others have a normalised name."""
    name = tokenised.select("country", norm_name(F.col("name_tokens")).alias("name"), (F.col("src") == 1).cast("long").alias("one"))
    return name.groupBy("country", "name").agg(F.sum("one").alias("n_s1"), F.sum(1 - F.col("one")).alias("n_rec"))


def with_frequency(tokenised: DataFrame) -> DataFrame:
    """Records with norm, their normalised name, and own_s1 and own_rec, how many records of source 1 and of the others have it.

    With these on both records of a pair, frequency_features needs no join of pairs.
    """
    own = name_frequency(tokenised).select("country", F.col("name").alias("norm"), F.col("n_s1").cast("double").alias("own_s1"), F.col("n_rec").cast("double").alias("own_rec"))
    return tokenised.withColumn("norm", norm_name(F.col("name_tokens"))).join(own, ["country", "norm"])


def frequency_features(sided: DataFrame) -> DataFrame:
    """sided: pairs with norm1, own_s1_1, own_rec_1 of the S1 record, and those in 2 of the other one."""
    return sided.withColumns({"s1name_in_s1": F.col("own_s1_1"), "rname_in_s1": F.col("own_s1_2"), "rname_in_r": F.col("own_rec_2"), "s1name_in_r": F.col("own_rec_1"), "same_norm_name": _flag(F.col("norm1") == F.col("norm2"))})


def name_freq_features(sided: DataFrame, frequency: DataFrame) -> DataFrame:
    named = sided.withColumns({"_x": norm_name(F.col("name1")), "_y": norm_name(F.col("name2"))})
    left = frequency.select("country", F.col("name").alias("_x"), F.col("n_s1").cast("double").alias("s1name_in_s1"), F.col("n_rec").cast("double").alias("s1name_in_r"))
    right = frequency.select("country", F.col("name").alias("_y"), F.col("n_s1").cast("double").alias("rname_in_s1"), F.col("n_rec").cast("double").alias("rname_in_r"))
    out = named.join(left, ["country", "_x"], "left").join(right, ["country", "_y"], "left").fillna(0.0, FREQUENCY_FEATURES[:4])
    return out.withColumn("same_norm_name", _flag(F.col("_x") == F.col("_y"))).drop("_x", "_y")

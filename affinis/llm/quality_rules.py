"""Host-level quality rules, in DataFrame functions only.

Each text gets its counts and the rules that it fails.  Failures are summed by host, each host's rate is shrunk
towards the rate of all hosts with a beta prior fitted to the hosts' rates (method of moments), and the
verdicts go back to the documents.  A host with a bad verdict loses the documents that fail any of the softer
rules; a document that fails no rule stays wherever it is from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import WORD_SPACE, durable, stored

MIN_WORDS = 20
#: Percent of words that may lie in repeated 8-word windows.
MAX_REPEATED = 30
WINDOW = 8
#: Softer rules: symbols per 100 words, percent of repeated lines, mean characters of a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 10, 30, (2, 15)
#: A host whose shrunk rate of failures is above this has a bad verdict.
HOST_RATE = 0.4


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of 8 words that the array holds twice or more; each word counts once.

    A window is known by the hash of its words' 64-bit hashes.  Most texts repeat none, which a count of the
    distinct windows shows; for the others windows are sorted by hash, and a sum over the repeated places in
    their order adds what each window covers beyond the one before.
    """

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return _let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))

    def covered(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def same(i: Column) -> Column:
                return F.coalesce(F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False))

            hit = F.filter(s, lambda x, i: same(i) | (F.when(i > 0, same(i - 1)).otherwise(False)))
            return F.array_sort(F.transform(hit, lambda x: x["i"]))

        def added(at: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

        return _let(_let(placed, twice), added)

    counted = _let(windows(words), lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


#: Verdicts on more hosts than this are joined by shuffle (a row has about 50 bytes).
FEW_HOSTS = 100_000


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str, *carried: Column) -> DataFrame:
    """id, host and the counts of each text; a null text has no words."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)
    split = base.withColumn("words", F.array_remove(F.split("text", WORD_SPACE), ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return split.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(lines, F.size).cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *split.columns[3:-1],
    )


def with_failures(measured: DataFrame) -> DataFrame:
    """Adds base_failed and soft_failed."""
    n, words = F.col("n_words"), F.greatest(F.col("n_words"), F.lit(1))
    soft = (F.col("n_symbols") * 100 > MAX_SYMBOLS * n) | (F.col("n_dup_lines") * 100 > MAX_DUP_LINES * F.col("n_lines")) | ~(F.col("word_chars") / words).between(*WORD_LENGTH)
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    return measured.withColumn("base_failed", base).withColumn("soft_failed", soft)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """h, host_rate and host_bad from the rows' host, base_failed and soft_failed."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    spread = hosts.agg(F.sum("failed").alias("f"), F.sum("docs").alias("d"), F.count("*").alias("k"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("docs")).alias("noise"))
    m = F.col("f") / F.col("d")
    between = F.col("v") - m * (1 - m) * F.col("noise")  # what binomial chance does not explain
    strength = F.when(between > 0, F.greatest(m * (1 - m) / between - 1, F.lit(0.01))).otherwise(F.col("d").cast("double"))
    prior = spread.select(m.alias("mean"), strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select(F.col("host").alias("h"), shrunk.alias("host_rate"), (shrunk > HOST_RATE).alias("host_bad"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, the counts, base_failed, the host's rate and verdict, and kept, for each row of docs.

    A null host is a host of its own.  An empty table gives an empty result.  With one host, or where hosts do
    not differ more than chance makes them, the prior is as strong as all rows and every host gets the common
    rate.  Rows with equal ids are judged each by its own text.  Other columns are ignored.
    """
    rows = durable(with_failures(measures(docs, id_col, text_col, host_col)))
    joined = rows.join(host_verdicts(rows), F.col("host").eqNullSafe(F.col("h")))
    kept = ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed"))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "soft_failed", F.round("host_rate", 9).alias("host_rate"), "host_bad")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that quality keeps, each judged by its own text and host, with the columns of docs.

    Rows travel with their flags and are not joined by id, so nulls, repeats and clashing names do no harm, and only
    the hosts' counts are shuffled.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    flags = with_failures(measures(docs, id_col, text_col, host_col, carried)).select("host", "base_failed", "soft_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row"))
    rows = stored(flags, "judged")
    verdicts = durable(host_verdicts(rows))
    bad = verdicts.filter("host_bad").select("h")
    bad = F.broadcast(bad) if verdicts.count() <= FEW_HOSTS else bad
    judged = rows.filter("not base_failed")
    kept = judged.filter("not soft_failed").unionByName(judged.filter("soft_failed").join(bad, F.col("host").eqNullSafe(F.col("h")), "left_anti"))
    return kept.select("row.*")

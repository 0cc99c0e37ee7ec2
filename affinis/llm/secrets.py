"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed.  The ledger has, for each blob, the rule versions that have
been run on it and what they found.  A scan reads each distinct blob once, runs on it only the rule versions
that the ledger lacks for it, adds the findings to the ledger, and joins them back to all paths with that blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import lean, shared_folder, small_batches

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Finds leftmost, non-overlapping matches; drops those whose group has fewer characters than `least`.

    hints: a text that has none of these strings, in lower case, has no match.
    """

    kind: str
    version: int
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_CASELESS = re.ASCII | re.IGNORECASE
BASE_RULES = (
    Rule("assign", 1, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", _CASELESS, 2, 8, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 0, 32),
)
ADDED_RULES = (
    Rule("private_key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", re.ASCII, 0, 0, ("private key-----",)),
    Rule("github", 3, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", re.ASCII, 0, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("slack", 3, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII, 0, 0, ("xox",)),
    Rule("jwt", 2, r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII, 0, 0, ("eyj",)),
    Rule("url_login", 3, r"\b[a-z][a-z0-9+.-]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]{3,}@", re.ASCII, 0, 0, ("://",)),
)
RULES = BASE_RULES + ADDED_RULES


def find(text: str, rules: tuple[Rule, ...], compiled: dict[str, re.Pattern], ranks: dict[str, int]) -> list[dict]:
    """Spans in code points, by start and then by the rules' order."""
    lower, out = None, []
    for r in rules:
        if r.hints:
            lower = text.lower() if lower is None else lower
            if not any(h in lower for h in r.hints):
                continue
        for m in compiled[r.key].finditer(text):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append({"start": m.start(), "rank": ranks[r.key], "kind": r.kind, "end": m.end()})
    return sorted(out, key=lambda x: (x["start"], x["rank"]))


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.key: re.compile(r.pattern, r.flags) for r in rules}
        ranks = {r.key: i for i, r in enumerate(rules)}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            texts, done = batch.column(1), batch.column(2)
            spans, scanned = [], []
            for t, d in zip(texts, done, strict=True):
                seen = set(d.as_py() or ())
                todo = tuple(r for r in rules if r.key not in seen)
                scanned.append([r.key for r in todo])
                spans.append(find(t.as_py(), todo, compiled, ranks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scanned, pa.list_(pa.string())), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return run


def address(text: Column) -> Column:
    """The content address of a blob; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(versions: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows for the ledger: blob, rules (keys now run on it), spans found by them; none for a blob that has all.

    A blob is read once however many rows have it: copies are dropped before the shuffle.  An empty table gives
    no rows.  Texts of any length are searched whole.
    """
    small_batches(versions.sparkSession)
    blobs = versions.select(address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        done = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        todo = blobs.join(done, "blob", "left").filter(F.size(F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))) > 0)
    return todo.select("blob", "text", "done").mapInArrow(lean(_scanner(rules)), f"blob string, rules array<string>, spans {SPANS}")


def ledger_folder(spark: SparkSession) -> str:
    """Where the ledger is kept: the setting spark.affinis.secrets.ledger, which makes runs incremental, else a new folder."""
    return spark.conf.get("spark.affinis.secrets.ledger", None) or f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"


#: Parts that the rows of each blob are dealt over when they meet its findings.
SALTS = 16


LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger's rows, none before its first scan."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(folder) if there else None


def update_ledger(versions: DataFrame, folder: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans the unseen pairs of blob and rule version, adds what was found to the ledger, and gives the ledger back.

    Each row of a ledger holds by itself, so one that a lost job wrote in part is used as far as it goes, and pairs that
    two jobs scanned at once do no harm.
    """
    spark = versions.sparkSession
    scan_blobs(versions, text_col, read_ledger(spark, folder), rules).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's id, blob and spans (an empty list where nothing is found), from a ledger that has all its blobs.

    Only findings of the given rule versions count.  A null text is empty and has no spans; rows with equal ids
    are rows of their own.  Other columns are ignored.
    """
    key_of = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.key)])
    mine = ledger.withColumn("spans", F.filter("spans", lambda s: F.array_contains("rules", key_of[s["kind"]]))).filter(F.size("spans") > 0)
    one = mine.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = versions.select(F.col(id_col).cast("long").alias("id"), address(F.col(text_col)).alias("blob"))
    # a blob that very many rows have is not one task's
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    out = dealt.join(one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["blob", "salt"], "left")
    return out.select(F.col("id").alias(id_col), "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and span lists in text form: n_assign, n_access, n_hex, base_sha256 (of the base kinds) and spans."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, base), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

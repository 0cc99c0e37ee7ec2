"""Registered queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions import text as tx
from affinis.functions.translit import transliterate
from affinis.operators import blocking, decide, evaluate, pairs, profile, ranking, records
from affinis.plans import fixtures as fx
from affinis.plans import linkage
from affinis.plans.fixtures import ENT, ER, GCOUNT, GOLD, KEYS, LAB, PAIRS, TOK, cand_sql, fold_sql, skeleton_sql, sql, tokens_sql, weights_sql
from affinis.sources import sinks, tables
from affinis.sources.shared import shared_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: A small cap, so that the cut by document frequency does something at the small scale factors.
CAP, K, M, REV = 100, 10, 3, 3
#: The caps that a run has unless told otherwise; queries named ..._production have them.
FULL = linkage.Config().word_cap
THRESHOLD = 0.7


def query(statement: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if statement:
            ORACLE_SQL[name or f.__name__] = statement
        return f

    return register


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def weighted(spark: SparkSession, sf_dir: str, cap: int = CAP) -> DataFrame:
    return linkage.stored_weights(fx.er_tokens(spark, sf_dir), cap, cap)


def near(spark: SparkSession, sf_dir: str, k: int = K, rev_m: int = REV, cap: int = CAP) -> DataFrame:
    return blocking.near_pairs(weighted(spark, sf_dir, cap), k, rev_m)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_pairs(fx.er_pairs(spark, sf_dir), fx.er_gold(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gold_counts(fx.er_entities(spark, sf_dir), fx.er_gold(spark, sf_dir))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.one_owner(decide.above_threshold(labelled(spark, sf_dir), THRESHOLD))


W = weights_sql(CAP, CAP)
SCORED = (ER, TOK, KEYS, W)
CANDS = (*SCORED, cand_sql(K, M, REV))
FULL_SCORED = (ER, TOK, KEYS, weights_sql(FULL, FULL))
FULL_CANDS = (*FULL_SCORED, cand_sql(K, M, REV))
LABELLED = (ER, GOLD, PAIRS, LAB)
ACC = f"acc AS (SELECT *, p >= {THRESHOLD} AND row_number() OVER (PARTITION BY country, r, p >= {THRESHOLD} ORDER BY p DESC, s1) = 1 AS accepted FROM lab)"
F05 = "CASE WHEN n_gold = 0 AND p = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 1.25 * (h / p) * (h / n_gold) / (0.25 * (h / p) + h / n_gold) END"


def counts_sql(acc: str = "acc", by: str = "") -> str:
    """Entities with their accepted and true pairs."""
    return f"cnt AS (SELECT g.*, coalesce(a.p, 0) AS p, coalesce(a.h, 0) AS h FROM {'gg' if by else 'gcount'} g LEFT JOIN (SELECT {by}country, s1, count(*) AS p, count(*) FILTER (is_true) AS h FROM {acc} WHERE accepted GROUP BY ALL) a USING ({by}country, s1))"


MACRO = f"round(avg({F05}), 6) AS macro_f05, round(sum(h) / greatest(sum(p), 1), 6) AS precision, round(sum(h) / greatest(sum(n_gold), 1), 6) AS recall"
METRICS = ("macro_f05", "precision", "recall")

# --- sources and sinks


@query(sql(ER, select="SELECT entity_id, business_name, business_address, country FROM er"))
def scan_tsv_strings(spark, sf_dir):
    path = shared_path(spark, "records")
    sinks.write_tsv(fx.er_records(spark, sf_dir).select(*tables.RECORD), path)
    return tables.scan_tsv(spark, path, tables.RECORD)


@query(sql(ER, select="SELECT entity_id, business_name, business_address, country, CAST(src AS INTEGER) AS src FROM er"))
def scan_sources(spark, sf_dir):
    folder = shared_path(spark, "split")
    for k in tables.SOURCES:
        sinks.write_tsv(fx.er_records(spark, sf_dir).filter(F.col("src") == k).select(*tables.RECORD), f"{folder}/train/train_source{k}.tsv")
    return tables.scan_sources(spark, folder, "train")


@query(sql(ER, GOLD, select="SELECT DISTINCT s1, r FROM gold"))
def gt_explode(spark, sf_dir):
    path = shared_path(spark, "truth")
    lists = sinks.id_lists(fx.er_entities(spark, sf_dir), fx.er_gold(spark, sf_dir), "matched_entity_ids")
    sinks.write_tsv(lists, path)
    return tables.ground_truth(spark, path)


@query("SELECT DISTINCT lang AS country FROM documents")
def distinct_countries(spark, sf_dir):
    er = fx.er_records(spark, sf_dir)
    return tables.countries_of(*[er.filter(F.col("src") == k) for k in tables.SOURCES])


@query(sql(ER, select="SELECT country, src, entity_id FROM er WHERE src = 2 UNION ALL SELECT country, src, entity_id FROM er WHERE src = 3"))
def u_concat_sources(spark, sf_dir):
    er = fx.er_records(spark, sf_dir).select("country", "src", "entity_id")
    return tables.concat_sources(er.filter("src = 2"), er.filter("src = 3"))


@query(sql(ER, GOLD, ENT, select="SELECT e.s1 AS source1_entity_id, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS matched_entity_ids FROM ent e LEFT JOIN gold g ON e.s1 = g.s1 GROUP BY 1"))
def sink_id_lists(spark, sf_dir):
    return sinks.id_lists(fx.er_entities(spark, sf_dir), fx.er_gold(spark, sf_dir), "matched_entity_ids")


@query(sql(ER, GOLD, PAIRS, select="SELECT DISTINCT s1, r FROM gold EXCEPT SELECT s1, r FROM pairs WHERE p >= 0.5"))
def sink_subset_check(spark, sf_dir):
    return sinks.not_candidates(fx.er_gold(spark, sf_dir), fx.er_pairs(spark, sf_dir).filter("p >= 0.5")).distinct()


DRAWN = "md5(entity_id || ':42')"


@query(
    sql(
        ER,
        GOLD,
        f"one AS (SELECT * FROM er WHERE src = 1 ORDER BY {DRAWN}, entity_id LIMIT 20)",
        "hit AS (SELECT * FROM er WHERE src <> 1 AND (country, entity_id) IN (SELECT (g.country, g.r) FROM gold g JOIN one o ON g.country = o.country AND g.s1 = o.entity_id))",
        f"free AS (SELECT * FROM er WHERE src <> 1 AND (country, entity_id) NOT IN (SELECT (country, r) FROM gold) ORDER BY {DRAWN}, entity_id LIMIT 30)",
        select="SELECT src, entity_id FROM one UNION ALL SELECT src, entity_id FROM hit UNION ALL SELECT src, entity_id FROM free",
    )
)
def sample_with_distractors(spark, sf_dir):
    return profile.sample_with_distractors(fx.er_records(spark, sf_dir), fx.er_gold(spark, sf_dir), 20, 30).select("src", "entity_id")


# --- scalar functions


@query(sql(ER, select=f"SELECT entity_id, {tokens_sql(fold_sql('business_name'))} AS tokens FROM er"))
def clean_tokens(spark, sf_dir):
    folded = tx.fold_columns(fx.er_records(spark, sf_dir), {"f": "business_name"})
    return folded.select("entity_id", tx.clean_tokens(F.col("f")).alias("tokens"))


@query("SELECT * FROM (VALUES ('सुपर', 'supr'), ('इम्पेक्स', 'impeks'), ('प्राइवेट', 'praaivet'), ('लिमिटेड', 'limited'), ('१२३ रोड', '123 rod'), ('अंक', 'ank'), ('हां', 'haa'), ('plain', 'plain')) AS t(raw, latin)", name="transliterate")
def transliterate_samples(spark, sf_dir):
    words = ["सुपर", "इम्पेक्स", "प्राइवेट", "लिमिटेड", "१२३ रोड", "अंक", "हां", "plain"]
    return spark.createDataFrame([(w,) for w in words], "raw string").select("raw", transliterate("raw").alias("latin"))


@query(f"SELECT p_partkey, {skeleton_sql('lower(p_name)')} AS skeleton FROM part")
def skeleton_word(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.skeleton_word(F.lower("p_name")).alias("skeleton"))


@query(sql(ER, TOK, select=f"SELECT entity_id, list_filter(list_transform(list_filter(name_tokens, lambda t: NOT regexp_full_match(t, '\\p{{Nd}}+')), lambda t: {skeleton_sql('t')}), lambda s: s <> '') AS skeleton FROM tk"))
def name_skeleton(spark, sf_dir):
    return fx.er_tokens(spark, sf_dir).select("entity_id", tx.name_skeleton(F.col("name_tokens")).alias("skeleton"))


@query(sql(ER, TOK, select="SELECT entity_id, array_to_string(name_tokens, ' ') AS norm_name FROM tk"))
def norm_name(spark, sf_dir):
    return fx.er_tokens(spark, sf_dir).select("entity_id", tx.norm_name(F.col("name_tokens")).alias("norm_name"))


@query(r"SELECT doc_id, regexp_matches(t, '[\x{0900}-\x{0D7F}]') AS has_indic FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'अ' || text ELSE text END AS t FROM documents)")
def has_indic(spark, sf_dir):
    mixed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("अ"), "text")).otherwise(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.has_indic(mixed).alias("has_indic"))


ADDRESS = "concat(p_size, ' ', p_brand, ' st, ', p_partkey, ' b', p_size, ' ', lpad(CAST(p_partkey AS STRING), 6, '0'))"
ADDRESS_SQL = "(p_size || ' ' || p_brand || ' st, ' || p_partkey || ' b' || p_size || ' ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0'))"


@query(f"SELECT p_partkey, list_filter({tokens_sql(fold_sql(ADDRESS_SQL))}, lambda t: regexp_full_match(t, '\\p{{Nd}}+'))[1:8] AS numbers FROM part")
def address_numbers(spark, sf_dir):
    tokens = tx.clean_tokens(F.lower(F.expr(ADDRESS)))
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.address_numbers(tokens).alias("numbers"))


@query(f"SELECT p_partkey, replace(regexp_extract_all({ADDRESS_SQL}, '\\b\\d{{3}}\\s?\\d{{2,3}}\\b')[-1], ' ', '') AS postal FROM part")
def postal_code(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.postal_code(F.expr(ADDRESS)).alias("postal"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ' ,x', ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM part")
def parse_ids(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.parse_ids(F.expr("concat(p_type, ', ,', p_brand, ' ,x')")).alias("ids"))


@query("SELECT p_partkey, regexp_replace(p_type || ' & ' || p_brand, '[^A-Za-z0-9]+', '_', 'g') AS safe FROM part")
def scalar_safe_name(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.safe_name(F.expr("concat(p_type, ' & ', p_brand)")).alias("safe"))


@query(sql(ER, TOK, PAIRS, select="SELECT p.s1, p.r, CAST(len(list_intersect(a.addr_tokens, b.addr_tokens)) AS BIGINT) AS shared, CAST(len(list_distinct(a.addr_tokens || b.addr_tokens)) AS BIGINT) AS in_either FROM pairs p JOIN tk a ON p.s1 = a.entity_id JOIN tk b ON p.r = b.entity_id"))
def set_overlap(spark, sf_dir):
    sided = pairs.with_sides(fx.er_pairs(spark, sf_dir).select("country", "s1", "r"), fx.er_tokens(spark, sf_dir))
    return sided.select("s1", "r", F.size(F.array_intersect("addr1", "addr2")).cast("long").alias("shared"), F.size(F.array_union("addr1", "addr2")).cast("long").alias("in_either"))


# --- blocking


@query(sql(ER, TOK, KEYS, select="SELECT * FROM keys"))
def blocking_keys(spark, sf_dir):
    return records.record_keys(fx.er_tokens(spark, sf_dir))


@query(sql(ER, TOK, KEYS, select="SELECT country, kind, key, count(*) AS df FROM keys GROUP BY ALL"))
def blocking_df(spark, sf_dir):
    return blocking.key_frequency(records.record_keys(fx.er_tokens(spark, sf_dir)))


@query(sql(*SCORED, select=f"SELECT country, kind, key, df, {s6('idf')} FROM idf"))
def blocking_idf(spark, sf_dir):
    tokens = fx.er_tokens(spark, sf_dir)
    out = blocking.key_idf(records.record_keys(tokens), tokens, blocking.caps(CAP, CAP))
    return out.select("country", "kind", "key", "df", *r6("idf"))


@query(sql(*SCORED, select=f"SELECT country, src, entity_id, kind, key, {s6('weight')} FROM wk"))
def blocking_l2(spark, sf_dir):
    return weighted(spark, sf_dir).select("country", "src", "entity_id", "kind", "key", *r6("weight"))


@query(sql(*SCORED, select=f"SELECT country, s1, r, src, score, fwd_rank FROM rk WHERE fwd_rank < {K}"))
def simjoin_topk(spark, sf_dir):
    return blocking.top_k(near(spark, sf_dir, rev_m=0), K).select("country", "s1", "r", "src", "score", F.col("fwd_rank").cast("long").alias("fwd_rank"))


@query(sql(*SCORED, select=f"SELECT country, s1, r, src, score, fwd_rank < {K} AS is_fwd FROM rk WHERE fwd_rank < {K} OR rev_rank < {REV}"))
def simjoin_bidirectional(spark, sf_dir):
    return blocking.bidirectional(near(spark, sf_dir), K, REV).select("country", "s1", "r", "src", "score", "is_fwd")


@query(sql(*CANDS, select="SELECT * FROM cand"))
def blocking_candidates(spark, sf_dir):
    return blocking.candidates(near(spark, sf_dir), K, M, REV)


@query(sql(*SCORED, select="SELECT country, s1, r, src, score FROM (SELECT *, row_number() OVER (PARTITION BY country, r ORDER BY score DESC, s1) AS again FROM rk WHERE fwd_rank < 5) WHERE again <= 2"))
def filter_candidates(spark, sf_dir):
    return blocking.filter_candidates(blocking.ranked_pairs(near(spark, sf_dir, 5, 0)), 5, 2).select("country", "s1", "r", "src", "score")


@query(sql(*SCORED, GOLD, select="SELECT g.country, g.s1, g.r, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN sp s ON g.country = s.country AND g.s1 = s.s1 AND g.r = s.r"))
def pair_score(spark, sf_dir):
    return blocking.pair_score(fx.er_gold(spark, sf_dir).distinct(), weighted(spark, sf_dir)).select("country", "s1", "r", "score")


GRID_K, GRID_M = (3, 5, 8, 10), (1, 2, 3)


@query(
    sql(
        *SCORED,
        GOLD,
        ENT,
        GCOUNT,
        f"gk AS (SELECT rk.*, k FROM rk, (VALUES {', '.join(f'({k})' for k in GRID_K)}) AS t(k) WHERE fwd_rank < k)",
        "gr AS (SELECT *, row_number() OVER (PARTITION BY k, country, r ORDER BY score DESC, s1) AS again FROM gk)",
        f"gm AS (SELECT gr.*, m FROM gr, (VALUES {', '.join(f'({m})' for m in GRID_M)}) AS t(m) WHERE again <= m)",
        "gl AS (SELECT gm.*, g.s1 IS NOT NULL AS is_true FROM gm LEFT JOIN (SELECT DISTINCT * FROM gold) g ON gm.country = g.country AND gm.s1 = g.s1 AND gm.r = g.r)",
        "n AS (SELECT country, sum(n_gold) AS gold, count(*) AS ents FROM gcount GROUP BY 1)",
        select="SELECT gl.country, k, m, round(count(*) FILTER (is_true) / greatest(any_value(gold), 1), 6) AS pair_recall, round(count(*) / any_value(ents), 6) AS cands_per_s1 FROM gl JOIN n ON gl.country = n.country GROUP BY ALL",
    )
)
def blocking_grid(spark, sf_dir):
    ranked = stored(evaluate.label_pairs(blocking.ranked_pairs(near(spark, sf_dir, max(GRID_K), 0)), fx.er_gold(spark, sf_dir)), "ranked")
    grid = ranked.withColumn("k", F.explode(F.array(*map(F.lit, GRID_K)))).filter("fwd_rank < k")
    grid = grid.withColumn("again", ranking.rank_within(("k", "country", "r"), "score", "s1")).withColumn("m", F.explode(F.array(*map(F.lit, GRID_M)))).filter("again < m")
    n = entities(spark, sf_dir).groupBy("country").agg(F.sum("n_gold").alias("gold"), F.count("*").alias("ents"))
    got = grid.groupBy("country", "k", "m").agg(F.sum(F.col("is_true").cast("long")).alias("h"), F.count("*").alias("c"))
    return got.join(n, "country").select("country", "k", "m", F.round(F.col("h") / F.greatest("gold", F.lit(1)), 6).alias("pair_recall"), F.round(F.col("c") / F.col("ents"), 6).alias("cands_per_s1"))


CL = "cl AS (SELECT c.*, g.s1 IS NOT NULL AS is_true FROM cand c LEFT JOIN (SELECT DISTINCT * FROM gold) g ON c.country = g.country AND c.s1 = g.s1 AND c.r = g.r)"
CC = "cc AS (SELECT g.*, coalesce(a.n, 0) AS n_cands, coalesce(a.h, 0) AS h FROM gcount g LEFT JOIN (SELECT country, s1, count(*) AS n, count(*) FILTER (is_true) AS h FROM cl GROUP BY ALL) a USING (country, s1))"
CEIL = "CASE WHEN n_gold = 0 THEN 1.0 WHEN h = 0 THEN 0.0 ELSE 1.25 * (h / n_gold) / (0.25 + h / n_gold) END"


def _recall(spark, sf_dir, cap=CAP):
    found = blocking.candidates(near(spark, sf_dir, cap=cap), K, M, REV)
    return evaluate.blocking_recall(evaluate.label_pairs(found, fx.er_gold(spark, sf_dir)), entities(spark, sf_dir))


@query(sql(*CANDS, GOLD, ENT, GCOUNT, CL, CC, select="SELECT country, round(sum(h) / greatest(sum(n_gold), 1), 6) AS pair_recall, round(sum(n_cands) / count(*), 6) AS cands_per_s1 FROM cc GROUP BY 1"))
def blocking_recall(spark, sf_dir):
    return _recall(spark, sf_dir).select("country", *r6("pair_recall", "cands_per_s1"))


@query(sql(*CANDS, GOLD, ENT, GCOUNT, CL, CC, select=f"SELECT country, round(avg({CEIL}), 6) AS ceiling_f05 FROM cc GROUP BY 1"))
def ceiling_f05(spark, sf_dir):
    return _recall(spark, sf_dir).select("country", *r6("ceiling_f05"))


# --- the same with the caps of a run


@query(sql(*FULL_SCORED, select=f"SELECT country, s1, r, src, score, fwd_rank FROM rk WHERE fwd_rank < {K}"))
def simjoin_topk_production(spark, sf_dir):
    return blocking.top_k(near(spark, sf_dir, rev_m=0, cap=FULL), K).select("country", "s1", "r", "src", "score", F.col("fwd_rank").cast("long").alias("fwd_rank"))


@query(sql(*FULL_SCORED, select=f"SELECT country, s1, r, src, score, fwd_rank < {K} AS is_fwd FROM rk WHERE fwd_rank < {K} OR rev_rank < {REV}"))
def simjoin_bidirectional_production(spark, sf_dir):
    return blocking.bidirectional(near(spark, sf_dir, cap=FULL), K, REV).select("country", "s1", "r", "src", "score", "is_fwd")


@query(sql(*FULL_CANDS, select="SELECT * FROM cand"))
def blocking_candidates_production(spark, sf_dir):
    return blocking.candidates(near(spark, sf_dir, cap=FULL), K, M, REV)


@query(sql(*FULL_CANDS, GOLD, ENT, GCOUNT, CL, CC, select="SELECT country, round(sum(h) / greatest(sum(n_gold), 1), 6) AS pair_recall, round(sum(n_cands) / count(*), 6) AS cands_per_s1 FROM cc GROUP BY 1"))
def blocking_recall_production(spark, sf_dir):
    return _recall(spark, sf_dir, FULL).select("country", *r6("pair_recall", "cands_per_s1"))


@query(sql(*FULL_CANDS, GOLD, ENT, GCOUNT, CL, CC, select=f"SELECT country, round(avg({CEIL}), 6) AS ceiling_f05 FROM cc GROUP BY 1"))
def ceiling_f05_production(spark, sf_dir):
    return _recall(spark, sf_dir, FULL).select("country", *r6("ceiling_f05"))


@query(
    sql(
        *SCORED,
        GOLD,
        select=f"SELECT g.country, count(*) AS n, round(avg(CAST(coalesce(k.fwd_rank < {K}, false) AS INT)), 6) AS forward, round(avg(CAST(coalesce(k.rev_rank < 1, false) AS INT)), 6) AS reverse_1, round(avg(CAST(coalesce(k.rev_rank < {REV}, false) AS INT)), 6) AS reverse_{REV}, round(avg(CAST(coalesce(k.fwd_rank < {K} OR k.rev_rank < {REV}, false) AS INT)), 6) AS either FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN rk k ON g.country = k.country AND g.s1 = k.s1 AND g.r = k.r GROUP BY 1",
    )
)
def reverse_recall(spark, sf_dir):
    ranked = blocking.ranked_pairs(near(spark, sf_dir)).select("country", "s1", "r", "fwd_rank", "rev_rank")
    found = fx.er_gold(spark, sf_dir).distinct().join(ranked, ["country", "s1", "r"], "left")
    hit = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    fwd, rev = F.col("fwd_rank") < K, F.col("rev_rank")
    return found.groupBy("country").agg(F.count("*").alias("n"), hit(fwd).alias("forward"), hit(rev < 1).alias("reverse_1"), hit(rev < REV).alias(f"reverse_{REV}"), hit(fwd | (rev < REV)).alias("either"))


@query(sql(*SCORED, GOLD, select=f"SELECT country, CASE WHEN coalesce(score, 0) <= 0 THEN 'zero' ELSE 'crowd' END AS kind, count(*) AS n FROM (SELECT DISTINCT g.country, g.s1, g.r, k.score, k.fwd_rank FROM gold g LEFT JOIN rk k ON g.country = k.country AND g.s1 = k.s1 AND g.r = k.r) WHERE coalesce(fwd_rank, 1000000) >= 2 GROUP BY ALL"))
def miss_kinds(spark, sf_dir):
    w = weighted(spark, sf_dir)
    found = blocking.top_k(blocking.near_pairs(w, 2, 0), 2).select("country", "s1", "r")
    missed = fx.er_gold(spark, sf_dir).distinct().join(found, ["country", "s1", "r"], "left_anti")
    return evaluate.miss_kinds(blocking.pair_score(missed, w)).groupBy("country", "kind").agg(F.count("*").alias("n"))


@query(sql(*SCORED, select="SELECT country, s1, src, CASE WHEN count(*) >= 3 THEN min(score) ELSE 0.0 END AS kth_score FROM rk WHERE fwd_rank < 3 GROUP BY ALL"))
def kth_score(spark, sf_dir):
    return ranking.kth_scores(blocking.top_k(near(spark, sf_dir, 3, 0), 3), 3)


# --- windows

CONTEXT = ("fwd_rank", "rev_rank", "s1_best", "n_cands_s1", "r_best", "n_cands_r", "r_second", "s1_gap", "s1_ratio", "r_gap", "r_margin")


@query(
    sql(
        *CANDS,
        "c1 AS (SELECT *, row_number() OVER (PARTITION BY country, s1, src ORDER BY score DESC, r) - 1 AS fwd_rank, row_number() OVER (PARTITION BY country, r ORDER BY score DESC, s1) - 1 AS rev_rank, max(score) OVER (PARTITION BY country, s1) AS s1_best, count(*) OVER (PARTITION BY country, s1) AS n_cands_s1, max(score) OVER (PARTITION BY country, r) AS r_best, count(*) OVER (PARTITION BY country, r) AS n_cands_r FROM cand)",
        "c2 AS (SELECT *, coalesce(max(CASE WHEN rev_rank = 1 THEN score END) OVER (PARTITION BY country, r), 0.0) AS r_second FROM c1)",
        select="SELECT country, s1, r, src, score, fwd_rank, rev_rank, s1_best, n_cands_s1, r_best, n_cands_r, r_second, round(s1_best - score, 6) AS s1_gap, round(score / greatest(s1_best, 1e-6), 6) AS s1_ratio, round(r_best - score, 6) AS r_gap, round(r_best - r_second, 6) AS r_margin FROM c2",
    )
)
def context_features(spark, sf_dir):
    out = ranking.context_features(blocking.candidates(near(spark, sf_dir), K, M, REV))
    ranks = [F.col(c).cast("long").alias(c) for c in CONTEXT[:2]]
    return out.select("country", "s1", "r", "src", "score", *ranks, *CONTEXT[2:7], *r6(*CONTEXT[7:]))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def rank_within(spark, sf_dir):
    place = ranking.rank_within(("o_custkey",), "o_totalprice", "o_orderkey").cast("long").alias("place")
    return fx.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", place)


@query(
    sql(
        "g AS (SELECT l_orderkey, l_linenumber, l_discount AS p1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) AS p1_rank_s1, max(l_discount) OVER w AS p1_max_s1, sum(CAST(l_discount >= 0.5 AS BIGINT)) OVER w AS p1_n50_s1, sum(l_discount) OVER w AS p1_sum_s1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))",
        select="SELECT l_orderkey, l_linenumber, p1, p1_rank_s1, p1_max_s1, round(p1_max_s1 - p1, 6) AS p1_gap_s1, CAST(p1_n50_s1 AS BIGINT) AS p1_n50_s1, round(p1_sum_s1, 6) AS p1_sum_s1, round(p1 / greatest(p1_max_s1, 1e-6), 6) AS p1_ratio_s1, coalesce(max(CASE WHEN p1_rank_s1 = 2 THEN p1 END) OVER (PARTITION BY l_orderkey), 0.0) AS p1_second_s1 FROM g",
    )
)
def group_features(spark, sf_dir):
    out = ranking.group_features(fx.table(spark, sf_dir, "lineitem"), ("l_orderkey",), "l_discount", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "p1", F.col("p1_rank_s1").cast("long").alias("p1_rank_s1"), "p1_max_s1", *r6("p1_gap_s1"), "p1_n50_s1", *r6("p1_sum_s1", "p1_ratio_s1"), "p1_second_s1")


# --- joins


@query(sql(ER, GOLD, select="SELECT g.s1, g.r, a.doc_id AS s1_doc, b.doc_id AS r_doc FROM gold g JOIN er a ON g.s1 = a.entity_id JOIN er b ON g.r = b.entity_id"))
def lookup_join(spark, sf_dir):
    er = fx.er_records(spark, sf_dir)
    left, right = er.select(F.col("entity_id").alias("s1"), F.col("doc_id").alias("s1_doc")), er.select(F.col("entity_id").alias("r"), F.col("doc_id").alias("r_doc"))
    return fx.er_gold(spark, sf_dir).join(left, "s1").join(right, "r").select("s1", "r", "s1_doc", "r_doc")


@query(sql(*LABELLED, select="SELECT s1, r, is_true FROM lab"))
def label_pairs(spark, sf_dir):
    return labelled(spark, sf_dir).select("s1", "r", "is_true")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


ROW_KEY = "lower(trim(business_name)) || '|' || lower(trim(business_address))"


@query(sql(ER, select=f"SELECT count(*) AS n, count(*) FILTER ({ROW_KEY} IN (SELECT {ROW_KEY} FROM er WHERE src = 3)) AS shared, round(count(*) FILTER ({ROW_KEY} IN (SELECT {ROW_KEY} FROM er WHERE src = 3)) / count(*), 6) AS rate FROM er WHERE src = 2"))
def overlap_rate(spark, sf_dir):
    er = fx.er_records(spark, sf_dir)
    return profile.overlap_rate(er.filter("src = 2"), er.filter("src = 3"), profile.row_key()).select("n", "shared", *r6("rate"))


def simple_sql(c: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / greatest(len(list_distinct({a} || {b})), 1)"


@query(
    sql(
        ER,
        GOLD,
        f"tp AS (SELECT g.country, b.src, a.business_name AS n1, b.business_name AS n2, a.business_address AS a1, b.business_address AS a2, {simple_sql('a.business_name')} AS t1, {simple_sql('b.business_name')} AS t2, {simple_sql('a.business_address')} AS u1, {simple_sql('b.business_address')} AS u2 FROM gold g JOIN er a ON g.s1 = a.entity_id JOIN er b ON g.r = b.entity_id)",
        select=f"SELECT country, src, count(*) AS n, round(avg(CAST(lower(n1) = lower(n2) AS INT)), 6) AS same_name, round(avg(CAST(lower(a1) = lower(a2) AS INT)), 6) AS same_address, round(avg({jaccard_sql('t1', 't2')}), 6) AS name_jaccard, round(avg({jaccard_sql('u1', 'u2')}), 6) AS addr_jaccard FROM tp GROUP BY 1, 2",
    )
)
def true_pair_stats(spark, sf_dir):
    er = fx.er_records(spark, sf_dir)
    side = lambda k, key: er.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"name_{k}"), F.col("business_address").alias(f"address_{k}"), *(["src"] if k == 2 else []))
    joined = fx.er_gold(spark, sf_dir).join(side(1, "s1"), "s1").join(side(2, "r"), "r")
    return profile.true_pair_stats(joined, ["country", "src"]).select("country", "src", "n", *r6("same_name", "same_address", "name_jaccard", "addr_jaccard"))

"""Record tables with their tokens, and blocking keys.

A record has country, src (1, 2 or 3), entity_id, business_name and business_address.  Texts are cleaned once here;
pairs only ever join the token columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.functions.text import COMPONENT, clean_tokens, fold_columns, has_indic, name_skeleton

KINDS = ("nu", "np", "au", "ab", "sk")
#: Words of a name that make pairs.
PAIR_WORDS = 6


def with_tokens(records: DataFrame) -> DataFrame:
    """Adds name_tokens, addr_tokens (over all components, in order) and addr_parts (tokens by comma component)."""
    marked = records.withColumn("_addr", F.replace(F.coalesce("business_address", F.lit("")), F.lit(","), F.lit(COMPONENT)))
    folded = fold_columns(marked, {"_n": "business_name", "_a": "_addr"})
    parts = F.transform(F.split("_a", COMPONENT), clean_tokens)
    return folded.withColumns({"name_tokens": clean_tokens(F.col("_n")), "addr_parts": parts}).withColumn("addr_tokens", F.flatten("addr_parts")).drop("_addr", "_n", "_a")


def _pairs(words: Column) -> Column:
    first = F.slice(words, 1, PAIR_WORDS)
    each = F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.lit(PAIR_WORDS)), lambda b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))))
    return F.array_distinct(F.flatten(each))


def _squash(tokens: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(tokens, 1, n), "")


def record_keys(tokenised: DataFrame, query_src: int = 1) -> DataFrame:
    """Long table country, src, entity_id, kind, key; one row for each distinct key of a record.

    Source query_src also gets squashed name prefixes and, whatever its script, skeleton keys; other sources get
    skeleton keys only for names in an Indian script, so that ordinary names keep their own norm.
    """
    t, n = F.col("name_tokens"), F.size("name_tokens")
    query = F.col("src") == query_src
    words = F.array_distinct(t)
    extra = F.array_compact(
        F.array(
            F.when(n >= 2, F.array_join(t, "")),
            F.when(n >= 3, _squash(t, n - 1)),
            F.when(query & (n >= 3), _squash(t, 2)),
            F.when(query & (n >= 4), _squash(t, 3)),
        )
    )
    sk = F.when(query | has_indic(F.col("business_name")), F.array_distinct(name_skeleton(t))).otherwise(F.array().cast("array<string>"))
    adjacent = F.flatten(F.transform("addr_parts", lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p) + 1), lambda a, b: F.concat_ws("_", a, b))))
    based = tokenised.withColumn("_sk", sk)
    s = F.col("_sk")
    kinds = {
        "nu": F.array_distinct(F.concat(words, extra)),
        "np": _pairs(words),
        "au": F.array_distinct("addr_tokens"),
        "ab": F.array_distinct(adjacent),
        "sk": F.array_distinct(F.concat(s, _pairs(s), F.when(F.size(s) >= 2, F.array(F.concat(F.lit("#"), F.array_join(s, "")))).otherwise(F.array().cast("array<string>")))),
    }
    by_kind = F.explode(F.create_map(*[x for k in KINDS for x in (F.lit(k), kinds[k])]))
    long = based.select("country", "src", "entity_id", by_kind.alias("kind", "keys"))
    return long.select("country", "src", "entity_id", "kind", F.explode("keys").alias("key"))

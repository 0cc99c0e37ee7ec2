"""Every registered query of record linkage against its SQL in DuckDB."""

import duckdb
import pytest

from affinis.plans import more_queries, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def rows_of(rows):
    return sorted((str([plain(v) for v in r]) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    assert more_queries.GRID
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert rows_of(df.select(*cols).collect()) == rows_of(want)


def test_every_query_has_a_name_and_rows(spark, sf):
    without = sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL))
    assert without == ["gbt_fit_predict", "pair_string_features", "stacking_oof"]
    for name in without:
        assert queries.QUERIES[name](spark, sf).count() > 0


def test_production_caps_keep_pairs_of_commoner_keys(spark, sf):
    sf = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("simjoin_topk", "link_records"):
        small = {(r.s1, r.r) for r in queries.QUERIES[name](spark, sf).collect()}
        df = queries.QUERIES[f"{name}_production"](spark, sf)
        cols = sorted(df.columns)
        full = df.select(*cols).collect()
        assert {(r.s1, r.r) for r in full} - small
        assert rows_of(full) == rows_of(con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[f'{name}_production']})").fetchall())

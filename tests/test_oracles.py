"""Every raster query that SQL can express gives DuckDB's rows."""

import duckdb
import pytest

from bandloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    if name not in ORACLES:
        pytest.skip("tested elsewhere")
    got = QUERIES[name](spark, sf_dir).toArrow()
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE a AS SELECT {columns} FROM ({ORACLES[name]}) AS q")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE b AS SELECT {columns} FROM got")
    assert duck.execute("SELECT count(*) FROM a").fetchall()[0][0] == got.num_rows > 0
    assert duck.execute("SELECT * FROM (FROM a EXCEPT ALL FROM b) LIMIT 3").fetchall() == []


def test_every_query_has_a_source():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 70

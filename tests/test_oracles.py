import math

import duckdb
import pytest

from braidwork.plans import core, extensions  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def tidy(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(core.ORACLES[name])
    names = want.columns
    assert columns == sorted(names)
    assert tidy([[r[c] for c in columns] for r in df.collect()]) == tidy([[r[names.index(c)] for c in columns] for r in want.fetchall()])


def test_every_query_has_an_oracle():
    assert set(core.QUERIES) == set(core.ORACLES)

import math

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return v
        return float(v) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = plain(found.fetchall(), columns)
    assert want, "an oracle without rows tests nothing"
    assert plain([tuple(r) for r in got.collect()], got.columns) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).take(1)


@pytest.mark.parametrize("name, most", [("video_clips", 15_000), ("video_score_mark", 40_000), ("rule_filter_text", 6_500), ("rule_verdicts", 6_500)])
def test_plans_compute_their_parts_once(spark, name, most):
    """Expressions that are copied into filters and users make plans that grow."""
    assert len(catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()) < most

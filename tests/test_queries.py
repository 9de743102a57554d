"""Every registered query of the library against its SQL."""

import pytest

from graphloom import queries as q

from .oracle import connect, expected, rows


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    got, want = rows(q.QUERIES[name](spark, data)), expected(duck, q.ORACLE_SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_queries_without_sql_have_rows(spark, data):
    for name in sorted(set(q.QUERIES) - set(q.ORACLE_SQL)):
        assert q.QUERIES[name](spark, data).count() > 0, name


def test_context_pack_respects_its_budget(spark, data):
    out = q.QUERIES["context_pack"](spark, data).toPandas()
    assert set(out.tier) <= {"body", "index", "omitted"}
    bodies = out[(out.tier == "body") & (out.id != out.query_id)]
    seeds = out[(out.id == out.query_id) & (out.tier == "body")].groupby("query_id").cost.sum()
    for seed, group in bodies.groupby("query_id"):
        assert group.cost.sum() + seeds.get(seed, 0) <= max(800, seeds.get(seed, 0) + group.cost.sum() * (seeds.get(seed, 0) < 800))

"""Windows over all rows in ranges of their order, against DuckDB."""

import random

import duckdb
import pytest

from tessera.operators import running
from tessera.plans.catalogue import QUERIES
from tessera.plans.lexer import QueryError
from tessera.session import Session
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.fixture
def ranged(spark, tmp_path, monkeypatch):
    """A session over a table with ties, nulls and NaN, and DuckDB over the same; ranges of few rows."""
    monkeypatch.setattr(running, "RANGE_BYTES", 1)
    rng = random.Random(7)
    pick = lambda *of: rng.choice([None, *of])
    rows = [(i, pick("a", "b", "B", "ä", ""), pick(-1.5, 0.0, 2.25, float("nan"), float("inf")), pick(*range(-3, 9)), rng.randrange(40)) for i in range(300)]
    for name, found in (("t", rows), ("u", rows[::3]), ("e", [])):
        spark.createDataFrame(found, "id bigint, s string, f double, v bigint, k int").repartition(3).write.parquet(str(tmp_path / name))
    session, con = Session(spark), duckdb.connect()
    for name in "tue":
        session.register(name, spark.read.parquet(str(tmp_path / name)))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}/*.parquet')")
    return session, con


def both(ranged, text, oracle=None):
    session, con = ranged
    found = session.execute(text)
    same(found, con, oracle or text)
    return plan(found)


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_numbered_without_one_task_of_all(spark):
    text = plan(QUERIES["order_nulls"](spark, SF))
    assert "row_number" not in text and "o_orderkey" not in text
    assert "windowspecdefinition(__p" in plan(QUERIES["win_nested_agg"](spark, SF))


@pytest.mark.parametrize("order", ["s DESC NULLS FIRST, id", "f NULLS FIRST, s DESC NULLS LAST, id DESC", "v DESC NULLS LAST, f, id", "k, id DESC", "s IS NULL DESC, v + k, id"])
def test_numbers_over_all_rows(ranged, order):
    assert "row_number" not in both(ranged, f"SELECT id, row_number() OVER (ORDER BY {order}) AS n, count(v) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS c FROM t")


@pytest.mark.parametrize("order", ["s DESC NULLS FIRST", "f NULLS FIRST", "k", "v DESC NULLS LAST, k"])
def test_peers_over_all_rows(ranged, order):
    over = f"OVER (ORDER BY {order})"
    text = f"SELECT id, rank() {over} AS r, dense_rank() {over} AS d, count(*) {over} AS n, count(v) FILTER (WHERE k > 20) {over} AS c, coalesce(sum(v) {over}, 0)::bigint AS s, min(s) {over} AS lo, max(f) FILTER (WHERE k < 5) {over} AS hi, max(v) OVER (PARTITION BY k) AS m FROM t WHERE id <> 7"
    both(ranged, text)


def test_blocks_around_windows_over_all_rows(ranged):
    session, con = ranged
    both(ranged, "WITH x AS (SELECT k, id FROM t WHERE id > 9), y AS (SELECT k, row_number() OVER (ORDER BY k DESC, id) + 1 AS n FROM x) SELECT y.k, y.n FROM y WHERE n % 2 = 0 UNION ALL SELECT k, rank() OVER (ORDER BY k) FROM u")
    both(ranged, "SELECT k, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, max(v) NULLS FIRST) AS r, sum(count(*)) OVER (ORDER BY k)::bigint AS s FROM t GROUP BY k HAVING count(*) > 4")
    both(ranged, "SELECT DISTINCT dense_rank() OVER w * 2 AS d, CASE WHEN rank() OVER w < 99 THEN s END AS c FROM t WINDOW w AS (ORDER BY s DESC NULLS LAST)")
    both(ranged, "SELECT t.id, u.s, row_number() OVER (ORDER BY t.id DESC, u.id) AS n FROM t JOIN u ON t.k = u.k")
    both(ranged, "SELECT id, row_number() OVER (ORDER BY id) AS n, rank() OVER (ORDER BY s NULLS FIRST) AS r FROM e")
    found = session.execute("SELECT id FROM t ORDER BY row_number() OVER (ORDER BY id DESC) LIMIT 3").collect()
    assert [r.id for r in found] == [299, 298, 297]
    assert [r.n for r in session.execute("SELECT id, row_number() OVER (ORDER BY 1) AS n FROM u ORDER BY n").collect()] == list(range(1, 101))
    with pytest.raises(QueryError):
        session.execute("SELECT sum(nope) OVER (ORDER BY id) FROM t")


@pytest.mark.parametrize("name", ["order_by_subquery", "corr_scalar_neq"])
def test_counts_under_an_inequality_compare_no_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Join Cross" not in text and "Join LeftOuter, (s_suppkey" not in text and "windowspecdefinition(__p" in text


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_counts_under_an_inequality(ranged, op):
    text = f"SELECT id, (SELECT count(*) FROM u AS x WHERE x.v {op} t.v) AS n, (SELECT count(x.s) FILTER (WHERE x.k > 5) FROM u AS x WHERE t.k + 1 {op} x.k AND x.id > 30 AND x.s IS NOT NULL) * 2 AS m, (SELECT count(*) FROM u AS x WHERE x.s {op} t.s) AS s FROM t WHERE id <> 5"
    assert "Join LeftOuter" not in both(ranged, text).replace("Join LeftOuter, (__p", "")
    both(ranged, f"SELECT id, (SELECT count(*) FROM u AS x WHERE x.f {op} t.v) AS n, (SELECT count(*) FROM u AS x WHERE x.f {op} t.f) AS f, (SELECT count(*) FROM e AS x WHERE x.id {op} t.id) AS e, (SELECT count(*) FROM (SELECT id, v * 2 AS w FROM t) AS x WHERE t.id {op} x.w) AS w FROM t")


def test_blocks_around_counts_under_an_inequality(ranged):
    session, con = ranged
    both(ranged, "SELECT k, n, (SELECT count(*) FROM u AS x WHERE x.v < y.v) AS m FROM (SELECT k, count(*) AS n, max(v) AS v FROM t GROUP BY k) AS y")
    both(ranged, "SELECT k, count(*) AS n, (SELECT count(*) FROM u AS x WHERE x.k < t.k) AS m FROM t GROUP BY k")
    both(ranged, "WITH w AS (SELECT v, id FROM u WHERE id > 9) SELECT id, (SELECT count(*) FROM w WHERE w.v < t.v) AS n, rank() OVER (ORDER BY k) AS r FROM t WHERE v > 2")
    both(ranged, "SELECT DISTINCT coalesce((SELECT count(*) FROM u AS x WHERE x.k >= t.k), 0) AS n FROM t")
    # other conditions on the outer row, or none that compares, stay as they are
    both(ranged, "SELECT id, (SELECT count(*) FROM u AS x WHERE x.k < t.k AND x.s = t.s) AS n, (SELECT count(*) FROM u AS x WHERE x.v < 3) AS m FROM t")
    found = session.execute("SELECT id FROM t ORDER BY (SELECT count(*) FROM t AS x WHERE x.id < t.id) DESC LIMIT 3").collect()
    assert [r.id for r in found] == [299, 298, 297]

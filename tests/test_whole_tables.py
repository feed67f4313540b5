"""Queries asked over whole tables, against brute force or their SQL without its bounds."""

import re

import duckdb
import pytest

from tessellate.operators import places
from tessellate.plans import registry

SF = "/root/testdata/sf0.001"


def words(text):
    return {w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 3}


def test_every_part_meets_every_other(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey * 9 AS p_partkey) FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    parts = [(k, words(f"{n} {t}")) for k, n, t in con.execute(f"SELECT p_partkey, p_name, p_type FROM '{tmp_path}/part.parquet'").fetchall()]
    want = set()
    for k, a in parts:
        best = sorted((-len(a & b) / len(a), j, len(a & b)) for j, b in parts if j != k and len(a & b) >= 0.6 * len(a))[:5]
        want |= {(k, j, n, round(-s, 4), i + 1) for i, (s, j, n) in enumerate(best)}
    rows = registry.QUERIES["j10_name_share"](spark, str(tmp_path)).collect()
    assert len(rows) == len(want) > 200
    assert {(r.row_id, r.page_id, r.n, r.share, r.place) for r in rows} == want


@pytest.fixture(scope="module")
def far_keys(tmp_path_factory):
    """lineitem with order keys up to 20000 and the connection that sees it."""
    folder, con = tmp_path_factory.mktemp("far"), duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey * 13 AS l_orderkey) FROM '{SF}/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["dml5_replace", "j13_deepest", "j14_located", "t23_read_back", "v3_answers"])
def test_all_orders(spark, far_keys, name):
    folder, con = far_keys
    df = registry.QUERIES[name](spark, folder)
    found = con.execute(re.sub(r" WHERE l_orderkey < \d+", "", registry.SQL[name]))
    names = [d[0] for d in found.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("name", ["a18_siblings", "dml5_replace", "j14_located"])
def test_rows_of_a_task_do_not_grow(spark, far_keys, name, monkeypatch):
    """Orders are dealt to as many tasks as their rows fill, in one shuffle."""
    folder, con = far_keys
    monkeypatch.setattr(places, "ROWS_A_TASK", 500)
    df = registry.QUERIES[name](spark, folder)
    n = con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert df.rdd.getNumPartitions() == -(-n // 500)
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_verdicts_of_all_lines(spark, far_keys):
    folder, con = far_keys
    df = registry.QUERIES["p3_verdicts"](spark, folder)
    found = con.execute(registry.SQL["p3_verdicts"].replace(" WHERE l_orderkey % 10 = 3", ""))
    names = [d[0] for d in found.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_cells_of_the_whole_log(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (user_id * 37 AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    log = con.execute(f"SELECT user_id, event_type FROM '{tmp_path}/events.parquet' ORDER BY ts, event_id").fetchall()
    held = {k for k, kind in dict(log).items() if kind != "error"}
    wanted = {*range(200), *(k + d for k, _ in log for d in (-1, 0, 1) if k + d >= 0)}
    got = [r.cell for r in registry.QUERIES["s12_cached_cells"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(k for k in wanted - held if "99" not in str(k))
    assert max(got) > 500

"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from weftline.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for name in os.listdir(sf_dir):
        found.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return found


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    rows = sorted(str(tuple(r)) for r in frame.select(columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = con.sql(f"SELECT {quoted} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(d[0] for d in con.sql(catalogue.ORACLE_SQL[name]).description) == columns
    assert rows == sorted(map(str, expected))


def test_whole_trade_graph(spark, sf_dir, con):
    """Ranks and components hold every customer with lines and every supplier, against union by hand."""
    edges = con.sql("SELECT DISTINCT o_custkey, l_suppkey + 1000000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey").fetchall()
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert dict(catalogue.QUERIES["connected_components"](spark, sf_dir).collect()) == root
    ranks = dict(catalogue.QUERIES["pagerank"](spark, sf_dir).collect())
    assert ranks.keys() == root.keys() and sum(ranks.values()) == pytest.approx(1)

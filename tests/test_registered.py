"""Registered queries run over whole tables."""

import json
from collections import Counter

from veilspark import registered


def rows(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def test_json_collections_hold_every_visible_event_in_order(spark, sf):
    props = [json.loads(p) for _, p, t in sorted(rows(spark, sf, "events", "event_id", "props", "event_type")) if t == "purchase"]
    assert len(props) > 10
    want = {"json_each_collect": [v for p in props for v in p.values()], "json_tree_collect": [x for p in props for x in (p, *p.values())]}
    for name, items in want.items():
        (got,) = registered.QUERIES[name](spark, sf).collect()
        assert json.loads(got["items"]) == items, name


def test_queries_equal_their_sql(spark, sf):
    """A plain form of the comparison that the registered SQL is for."""
    import duckdb

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "orders", "events", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("json_extract_kinds", "json_tree_path", "cast_text_double", "cast_text_kinds", "lower_upper_letters", "like_letters", "glob_column_pattern", "update_returning", "insert_returning", "result_envelope", "idempotent_replay", "transaction_commit", "rejected_statements", "explain_columns", "visible_columns"):
        frame = registered.QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({registered.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in frame.collect()))) == sorted(map(str, want)), name


def test_three_way_join_and_aliases_leave_no_row_out(spark):
    sf = "/root/testdata/sf0.01"
    customers = {c: b for c, b, s in rows(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment") if s == "BUILDING"}
    orders = [(o, c) for o, c, s in rows(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus") if s == "O"]
    lines = {}
    for o, n, p, s in rows(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"):
        if s == "O":
            lines.setdefault(o, []).append((n, p))
    want = Counter((c, o, *x) for o, c in orders if c in customers for x in lines.get(o, [(None, None)]))
    assert max(customers) > 200 and Counter(map(tuple, registered.QUERIES["three_way_join"](spark, sf).collect())) == want
    counts = Counter(c for _, c in orders)
    assert [tuple(r) for r in registered.QUERIES["count_order_alias"](spark, sf).collect()] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in registered.QUERIES["order_alias"](spark, sf).collect()] == sorted(customers.items(), key=lambda x: (-x[1], x[0]))

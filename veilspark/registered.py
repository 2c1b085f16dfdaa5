"""Queries over the star tables that exercise every operator, each with the SQL that says what it should return."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.catalog import manifest_of
from veilspark.engine import Engine, Limits
from veilspark.errors import Rejected
from veilspark.sources.snapshots import Store, scratch_root
from veilspark.types import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "profiles")

_PROFILE = {"type": "object", "properties": {"name": {"type": "string"}, "keys": {"type": "array", "items": {"type": "integer"}}, "rich": {"type": "boolean"}, "balance": {"type": "number"}, "at": {"type": "object", "properties": {"nation": {"type": "integer"}}}}}
_JSON = {"props": {"type": "json", "jsonSchema": {"type": "object", "additionalProperties": False, "properties": {"k": {"type": "integer"}}}}}
_ALL = {"n_nationkey": {"is_null": False}}


def _select(columns: list, filter: dict, **more: Any) -> dict:
    return {"select": {"columns": columns, "filter": filter, "allow_aggregations": True, "allow_windows": True, **more}}


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]

#: One filter for each operator of the policy language, on a role of its own.
POLICY_OPS: dict[str, tuple[dict, str]] = {
    "eq": ({"o_orderstatus": {"eq": {"session": "order_status"}}}, "o_orderstatus = 'O'"),
    "neq": ({"o_orderstatus": {"neq": "O"}}, "o_orderstatus <> 'O'"),
    "lt": ({"o_totalprice": {"lt": 100000.5}}, "o_totalprice < 100000.5"),
    "lte": ({"o_custkey": {"lte": 40}}, "o_custkey <= 40"),
    "gt": ({"o_totalprice": {"gt": 200000.5}}, "o_totalprice > 200000.5"),
    "gte": ({"o_orderkey": {"gte": 1000}}, "o_orderkey >= 1000"),
    "like": ({"o_orderpriority": {"like": "%urgent"}}, "lower(o_orderpriority) LIKE '%urgent'"),
    "in": ({"o_orderpriority": {"in": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_in": ({"o_orderstatus": {"not_in": ["F", "P"]}}, "o_orderstatus NOT IN ('F', 'P')"),
    "is_null": ({"o_orderdate": {"is_null": False}}, "o_orderdate IS NOT NULL"),
    "and": ({"and": [{"o_orderstatus": {"eq": "O"}}, {"o_custkey": {"gt": 10}}]}, "o_orderstatus = 'O' AND o_custkey > 10"),
    "or": ({"or": [{"o_orderstatus": {"eq": "P"}}, {"o_custkey": {"lt": 30}}]}, "o_orderstatus = 'P' OR o_custkey < 30"),
    "not": ({"not": {"o_orderstatus": {"eq": "O"}}}, "NOT o_orderstatus = 'O'"),
    "column": ({"o_orderkey": {"gt": {"column": "o_custkey"}}}, "o_orderkey > o_custkey"),
}


def policies() -> dict:
    tenant = lambda column, key: {column: {"eq": {"session": key}}}
    segment = tenant("c_mktsegment", "segment")
    out = {
        "region": _select(["r_regionkey", "r_name"], {"r_name": {"is_null": False}}),
        "nation": _select(["n_nationkey", "n_name", "n_regionkey"], _ALL) | {"insert": {"columns": ["n_nationkey", "n_name"], "presets": {"n_regionkey": {"literal": 3}}, "check": {"n_regionkey": {"eq": 3}}, "returning": {"columns": ["n_nationkey", "n_name"]}}},
        "customer": _select(_CUSTOMER, segment)
        | {"update": {"columns": ["c_name"], "presets": {"c_nationkey": {"literal": 7}}, "filter": segment, "check": segment, "returning": {"columns": ["c_custkey", "c_name"]}}, "delete": {"filter": segment, "returning": {"columns": ["c_custkey"]}}},
        "supplier": _select(["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], {"s_acctbal": {"gt": 0.5}}),
        "part": _select(["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"], {"p_size": {"gte": 5}}),
        "orders": _select(_ORDERS, tenant("o_orderstatus", "order_status")),
        "lineitem": _select(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"], {"l_linestatus": {"eq": "O"}}),
        "events": _select(["event_id", "user_id", "event_type", "props", "ts", {"value": {"visible_if": {"user_id": {"lte": 40}}, "on_deny": "null"}}], tenant("event_type", "event_type")),
        "documents": _select(["doc_id", "source", "n_chars", "text"], tenant("lang", "lang")),
        "profiles": _select(["c_custkey", "rich", "profile"], segment),
    }
    spec = {"version": 1, "resources": {k: {"roles": {"analyst": v}} for k, v in out.items()}}
    spec["resources"]["customer"]["roles"]["capped"] = _select(["c_custkey", "c_name"], segment, limit=7)
    spec["resources"]["documents"]["roles"]["reader"] = _select(["doc_id", "text"], {"lang": {"eq": "fr"}})
    for op, (filter_, _) in POLICY_OPS.items():
        spec["resources"]["orders"]["roles"][f"op_{op}"] = _select(_ORDERS, filter_)
    return spec


#: The key that each query's write carries; every query writes a store of its own.
_KEY = "registered:0000000001"
VALUES = {"segment": "BUILDING", "order_status": "O", "event_type": "purchase", "lang": "en"}


def session(role: str = "analyst") -> Session:
    return Session.of(role, "user_1", **VALUES)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; profiles are customers with a boolean and a JSON document each."""
    if name != "profiles":
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    document = F.to_json(F.struct(F.col("c_name").alias("name"), F.array("c_nationkey", "c_custkey").alias("keys"), (F.col("c_acctbal") > 0).alias("rich"), F.col("c_acctbal").alias("balance"), F.struct(F.col("c_nationkey").alias("nation")).alias("at")))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("rich"), document.alias("profile"))


_KNOWN: dict[str, dict] = {}


def _schemas(sf_dir: str, read: Callable[[str], DataFrame]) -> dict:
    """Footers are read once for each folder; schemas don't change under a running process."""
    if sf_dir not in _KNOWN:
        _KNOWN[sf_dir] = {t: read(t).schema for t in TABLES}
    return _KNOWN[sf_dir]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    tables = lambda name: read(spark, sf_dir, name)
    schemas = _schemas(sf_dir, tables)
    return Engine(spark, manifest_of(schemas, {"events": _JSON, "profiles": {"profile": {"type": "json", "jsonSchema": _PROFILE}}}), policies(), tables=tables, schemas=schemas, limits=Limits(rows=None, bytes=None, keys=False))


_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz"
_C, _O, _L, _E = "c_mktsegment = 'BUILDING'", "o_orderstatus = 'O'", "l_linestatus = 'O'", "event_type = 'purchase'"

#: name -> (statement, parameters, role, oracle SQL; none where SQL leaves the order of elements open)
SELECTS: dict[str, tuple[str, dict[str, Any], str, str | None]] = {
    "row_policy_basic": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = :p ORDER BY o_orderkey LIMIT :n", {"p": "1-URGENT", "n": 500}, "analyst", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_O} AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 500"),
    "column_projection_alias": ("SELECT c_custkey AS id, c_acctbal AS balance, c_name FROM customer", {}, "analyst", f"SELECT c_custkey AS id, c_acctbal AS balance, c_name FROM customer WHERE {_C}"),
    "constant_select": ("SELECT 1 AS one, 2.5 AS half", {}, "analyst", "SELECT 1::BIGINT AS one, 2.5::DOUBLE AS half"),
    "cmp_eq": ("SELECT c_custkey FROM customer WHERE c_nationkey = :n", {"n": 5}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND c_nationkey = 5"),
    "cmp_ne": ("SELECT c_custkey FROM customer WHERE c_nationkey <> :n", {"n": 5}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND c_nationkey <> 5"),
    "cmp_lt": ("SELECT c_custkey FROM customer WHERE c_acctbal < 1000.5", {}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND c_acctbal < 1000.5"),
    "cmp_le": ("SELECT c_custkey FROM customer WHERE c_custkey <= 300", {}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND c_custkey <= 300"),
    "cmp_gt": ("SELECT o_orderkey FROM orders WHERE o_orderdate > :d", {"d": "1997-01-01 00:00:00"}, "analyst", f"SELECT o_orderkey FROM orders WHERE {_O} AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00'"),
    "cmp_ge": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= :t", {"t": 250000.25}, "analyst", f"SELECT o_orderkey FROM orders WHERE {_O} AND o_totalprice >= 250000.25"),
    "bool_and_or_not": ("SELECT c_custkey FROM customer WHERE (c_custkey < 100 OR c_acctbal > 9000.0) AND NOT c_nationkey = :n", {"n": 3}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND (c_custkey < 100 OR c_acctbal > 9000) AND NOT c_nationkey = 3"),
    "is_null": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL", {}, "analyst", f"SELECT c_custkey FROM (SELECT * FROM customer WHERE {_C}) c LEFT JOIN orders o ON o_custkey = c_custkey AND {_O} WHERE o_orderkey IS NULL"),
    "is_not_null": ("SELECT c_custkey FROM customer WHERE c_name IS NOT NULL", {}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND c_name IS NOT NULL"),
    "in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority IN (:a, '5-LOW')", {"a": "1-URGENT"}, "analyst", f"SELECT o_orderkey FROM orders WHERE {_O} AND o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_in_list": ("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')", {}, "analyst", f"SELECT o_orderkey FROM orders WHERE {_O} AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    "like_ci": ("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE :p", {"p": "CUSTOMER%1_"}, "analyst", f"SELECT c_custkey, c_name FROM customer WHERE {_C} AND lower(c_name) LIKE 'customer%1_'"),
    "not_like": ("SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%7%'", {}, "analyst", f"SELECT c_custkey FROM customer WHERE {_C} AND c_name NOT LIKE '%7%'"),
    "glob_cs": ("SELECT n_nationkey, n_name FROM nation WHERE n_name GLOB :p", {"p": "*A*"}, "analyst", "SELECT n_nationkey, n_name FROM nation WHERE n_name GLOB '*A*'"),
    "not_glob": ("SELECT n_nationkey FROM nation WHERE n_name NOT GLOB '*a?*'", {}, "analyst", "SELECT n_nationkey FROM nation WHERE NOT n_name GLOB '*a?*'"),
    "derived_table": ("SELECT d.id, d.c_name FROM (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey < 500) AS d WHERE d.id > 20", {}, "analyst", f"SELECT c_custkey AS id, c_name FROM customer WHERE {_C} AND c_custkey < 500 AND c_custkey > 20"),
    "cte_filtered": ("WITH rich AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0) SELECT c_custkey, c_acctbal FROM rich", {}, "analyst", f"SELECT c_custkey, c_acctbal FROM customer WHERE {_C} AND c_acctbal > 5000"),
    "cte_join": ("WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_name LIKE :p) SELECT x.id, o.o_orderkey FROM c AS x JOIN orders AS o ON o.o_custkey = x.id", {"p": "%3%"}, "analyst", f"SELECT c_custkey AS id, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_C} AND {_O} AND c_name LIKE '%3%'"),
    "inner_join": ("SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", {}, "analyst", f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_C} AND {_O}"),
    "inner_join_theta": ("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey > r.r_regionkey AND n.n_name LIKE '%a%'", {}, "analyst", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey > r_regionkey AND lower(n_name) LIKE '%a%'"),
    "left_join_policy_on": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000.0", {}, "analyst", f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {_O} AND o_totalprice > 300000 WHERE {_C}"),
    "three_way_join": (
        "SELECT c.c_custkey, o.o_orderkey, l.l_linenumber, l.l_partkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey", {}, "analyst",
        f"SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND {_L} WHERE {_C} AND {_O}",
    ),
    "exists_semi": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000.0)", {}, "analyst", f"SELECT c_custkey FROM customer c WHERE {_C} AND EXISTS (SELECT 1 FROM orders o WHERE {_O} AND o_custkey = c_custkey AND o_totalprice > 300000)"),
    "not_exists_anti": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)", {}, "analyst", f"SELECT c_custkey FROM customer c WHERE {_C} AND NOT EXISTS (SELECT 1 FROM orders o WHERE {_O} AND o_custkey = c_custkey)"),
    "exists_in_or": ("SELECT c_custkey FROM customer c WHERE c.c_custkey < 40 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000.0)", {}, "analyst", f"SELECT c_custkey FROM customer c WHERE {_C} AND (c_custkey < 40 OR EXISTS (SELECT 1 FROM orders o WHERE {_O} AND o_custkey = c_custkey AND o_totalprice > 400000))"),
    "exists_nested": (
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey > c.c_custkey))", {}, "analyst",
        f"SELECT c_custkey FROM customer c WHERE {_C} AND EXISTS (SELECT 1 FROM orders o WHERE {_O} AND o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE {_L} AND l_orderkey = o_orderkey AND l_partkey > c_custkey))",
    ),
    "count_global": ("SELECT COUNT(*) AS n FROM lineitem", {}, "analyst", f"SELECT count(*) AS n FROM lineitem WHERE {_L}"),
    "group_count": ("SELECT l_returnflag, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber", {}, "analyst", f"SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE {_L} GROUP BY ALL"),
    "group_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > :m", {"m": 5}, "analyst", f"SELECT o_custkey, count(*) AS n FROM orders WHERE {_O} GROUP BY o_custkey HAVING count(*) > 5"),
    "join_group_count": ("SELECT c.c_nationkey, COUNT(*) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey", {}, "analyst", f"SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_C} AND {_O} GROUP BY c_nationkey"),
    "count_order_alias": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey", {}, "analyst", f"SELECT o_custkey, count(*) AS n FROM orders WHERE {_O} GROUP BY o_custkey ORDER BY n DESC, o_custkey"),
    "row_number_part": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders", {}, "analyst", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE {_O}"),
    "row_number_nopart": ("SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer", {}, "analyst", f"SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer WHERE {_C}"),
    "order_desc": ("SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey", {}, "analyst", f"SELECT c_custkey, c_name FROM customer WHERE {_C}"),
    "order_alias": ("SELECT c_custkey, c_acctbal AS b FROM customer ORDER BY b DESC, c_custkey", {}, "analyst", f"SELECT c_custkey, c_acctbal AS b FROM customer WHERE {_C} ORDER BY b DESC, c_custkey"),
    "order_hidden_col": ("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15", {}, "analyst", f"SELECT c_name FROM customer WHERE {_C} ORDER BY c_acctbal, c_custkey LIMIT 15"),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", {}, "analyst", f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_O} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT :n OFFSET :m", {"n": 25, "m": 40}, "analyst", f"SELECT o_orderkey FROM orders WHERE {_O} ORDER BY o_orderkey LIMIT 25 OFFSET 40"),
    "policy_limit": ("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100", {}, "capped", f"SELECT c_custkey, c_name FROM customer WHERE {_C} ORDER BY c_custkey LIMIT 7"),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000.0 THEN 'high' WHEN o_totalprice > 100000.0 THEN :m ELSE 'low' END AS band FROM orders", {"m": "middle"}, "analyst", f"SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders WHERE {_O}"),
    "concat": ("SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer", {}, "analyst", f"SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer WHERE {_C}"),
    "cast_text_int": ("SELECT CAST(c_custkey AS TEXT) AS t, CAST(c_nationkey AS TEXT) AS u FROM customer", {}, "analyst", f"SELECT c_custkey::VARCHAR AS t, c_nationkey::VARCHAR AS u FROM customer WHERE {_C}"),
    "fn_lower": ("SELECT c_custkey, LOWER(c_name) AS low FROM customer", {}, "analyst", f"SELECT c_custkey, lower(c_name) AS low FROM customer WHERE {_C}"),
    "fn_upper": ("SELECT c_custkey, UPPER(c_name) AS up FROM customer", {}, "analyst", f"SELECT c_custkey, upper(c_name) AS up FROM customer WHERE {_C}"),
    "json_extract_scalar": ("SELECT event_id, JSON_EXTRACT(props, '$.k') AS k FROM events", {}, "analyst", f"SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE {_E}"),
    "json_each_collect": ("SELECT json_group_array(j.value) AS items FROM events AS e, json_each(e.props, :path) AS j", {"path": "$"}, "analyst", f"SELECT '[' || string_agg(json_extract_string(props, '$.k'), ',' ORDER BY event_id) || ']' AS items FROM events WHERE {_E}"),
    "json_tree_collect": ("SELECT json_group_array(j.value) AS items FROM events AS e, json_tree(e.props, '$') AS j", {}, "analyst", f"SELECT '[' || string_agg('{{\"k\":' || json_extract_string(props, '$.k') || '}},' || json_extract_string(props, '$.k'), ',' ORDER BY event_id) || ']' AS items FROM events WHERE {_E}"),
    "json_each_path": ("SELECT json_group_array(j.value) AS items FROM profiles AS p, json_each(p.profile, '$.keys') AS j", {}, "analyst", f"SELECT '[' || string_agg(c_nationkey || ',' || c_custkey, ',' ORDER BY c_custkey) || ']' AS items FROM customer WHERE {_C}"),
    "json_tree_path": ("SELECT json_group_array(j.value) AS items FROM profiles AS p, json_tree(p.profile, '$.at') AS j", {}, "analyst", f"SELECT '[' || string_agg('{{\"nation\":' || c_nationkey || '}},' || c_nationkey, ',' ORDER BY c_custkey) || ']' AS items FROM customer WHERE {_C}"),
    "json_extract_kinds": (
        "SELECT c_custkey, JSON_EXTRACT(profile, '$.name') AS name, JSON_EXTRACT(profile, '$.keys[1]') AS second, JSON_EXTRACT(profile, '$.keys') AS keys, JSON_EXTRACT(profile, '$.rich') AS rich, JSON_EXTRACT(profile, '$.balance') AS balance, JSON_EXTRACT(profile, '$.at.nation') AS nation FROM profiles", {}, "analyst",
        f"SELECT c_custkey, c_name AS name, c_custkey::BIGINT AS second, '[' || c_nationkey || ',' || c_custkey || ']' AS keys, (c_acctbal > 0)::BIGINT AS rich, c_acctbal::DOUBLE AS balance, c_nationkey::BIGINT AS nation FROM customer WHERE {_C}",
    ),
    "cast_text_kinds": ("SELECT c_custkey, CAST(rich AS TEXT) AS t FROM profiles", {}, "analyst", f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS t FROM customer WHERE {_C}"),
    "cast_text_double": ("SELECT c_custkey, CAST(c_acctbal AS TEXT) AS t FROM customer", {}, "analyst", f"SELECT c_custkey, c_acctbal::DOUBLE::VARCHAR AS t FROM customer WHERE {_C}"),
    "lower_upper_letters": ("SELECT doc_id, LOWER(text) AS low, UPPER(text) AS up FROM documents", {}, "reader", f"SELECT doc_id, translate(text, '{_ASCII}') AS low, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up FROM documents WHERE lang = 'fr'"),
    "like_letters": ("SELECT doc_id FROM documents WHERE text LIKE :p", {"p": "%É%A_"}, "reader", f"SELECT doc_id FROM documents WHERE lang = 'fr' AND translate(text, '{_ASCII}') LIKE '%É%a_'"),
    "like_column_pattern": ("SELECT c.c_custkey, n.n_nationkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey AND NOT c.c_name LIKE n.n_name AND c.c_name LIKE c.c_name", {}, "analyst", f"SELECT c_custkey, n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE {_C} AND NOT lower(c_name) LIKE lower(n_name)"),
    "glob_column_pattern": ("SELECT c.c_custkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_name GLOB c.c_name AND n.n_name NOT GLOB c.c_name", {}, "analyst", f"SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE {_C} AND c_name GLOB c_name AND NOT n_name GLOB c_name"),
    "redact_conditional": ("SELECT event_id, value FROM events", {}, "analyst", f"SELECT event_id, CASE WHEN user_id <= 40 THEN value END AS value FROM events WHERE {_E}"),
    **{f"policy_ops_{op}": ("SELECT o_orderkey, o_custkey FROM orders", {}, f"op_{op}", f"SELECT o_orderkey, o_custkey FROM orders WHERE {sql}") for op, (_, sql) in POLICY_OPS.items()},
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, params, role, _ = SELECTS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).sql(sql, session(role), params)

    query.__name__ = name
    return query


def _writable(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    store = Store(spark, scratch_root(spark))
    store.create({t: read(spark, sf_dir, t) for t in tables})
    all_ = policies()
    spec = all_ | {"resources": {t: {"roles": {"analyst": all_["resources"][t]["roles"]["analyst"]}} for t in tables}}
    return Engine(spark, manifest_of(store.schemas(store.current())), spec, store=store, limits=Limits(rows=None, bytes=None, transaction_bytes=None, transaction_seconds=None))


def insert_preset_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _writable(spark, sf_dir, "nation")
    e.execute([{"sql": "INSERT INTO nation (n_nationkey, n_name) VALUES (:a, 'ATLANTIS'), (:b, 'LEMURIA') RETURNING n_nationkey, n_name", "params": {"a": 100, "b": 101}, "expect": {"affectedRows": 2}}], session(), idempotency_key=_KEY)
    return e.store.read(e.store.current(), "nation")


def update_preset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _writable(spark, sf_dir, "customer")
    e.execute([{"sql": "UPDATE customer SET c_name = :n WHERE c_custkey < 100", "params": {"n": "renamed"}}], session(), idempotency_key=_KEY)
    return e.store.read(e.store.current(), "customer")


def delete_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _writable(spark, sf_dir, "customer")
    e.execute([{"sql": "DELETE FROM customer WHERE c_acctbal < 2000.0"}], session(), idempotency_key=_KEY)
    return e.store.read(e.store.current(), "customer")


def atomic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to two tables in one envelope; the second reads nothing of the first's table."""
    e = _writable(spark, sf_dir, "customer", "nation")
    e.execute([{"sql": "DELETE FROM customer WHERE c_custkey >= 100"}, {"sql": "INSERT INTO nation (n_nationkey, n_name) VALUES (:a, 'ATLANTIS')", "params": {"a": 100}}, {"sql": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5"}], session(), idempotency_key=_KEY)
    return e.sql("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey", session())


def _returned(spark: SparkSession, result: dict, kinds: str) -> DataFrame:
    """An envelope's rows as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in result["rows"]], kinds)


def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that RETURNING gives: the new values of all that were updated."""
    e = _writable(spark, sf_dir, "customer")
    out = e.execute([{"sql": "UPDATE customer SET c_name = :n RETURNING c_custkey, c_name", "params": {"n": "renamed"}}], session(), idempotency_key=_KEY)
    return _returned(spark, out["results"][0], "c_custkey long, c_name string")


def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _writable(spark, sf_dir, "customer")
    out = e.execute([{"sql": "DELETE FROM customer RETURNING c_custkey"}], session(), idempotency_key=_KEY)
    return _returned(spark, out["results"][0], "c_custkey long")


def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _writable(spark, sf_dir, "nation")
    out = e.execute([{"sql": "INSERT INTO nation (n_nationkey, n_name) VALUES (:a, 'ATLANTIS'), (:b, 'LEMURIA') RETURNING n_nationkey, n_name", "params": {"a": 100, "b": 101}}], session(), idempotency_key=_KEY)
    return _returned(spark, out["results"][0], "n_nationkey long, n_name string")


def result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An envelope's rows with what was redacted in each."""
    out = engine(spark, sf_dir).execute([{"sql": "SELECT event_id, value FROM events"}], session())["results"][0]
    rows = [(i, v, ",".join(hidden)) for (i, v), hidden in zip(out["rows"], out["redactions"], strict=True)]
    return spark.createDataFrame(rows, "event_id long, value double, redacted string")


def idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same request twice under one key, and once by someone else under the same key: two inserts in all."""
    e = _writable(spark, sf_dir, "nation")
    other = Session.of("analyst", "user_2", **VALUES)
    for k, who in enumerate((session(), session(), other)):
        e.execute([{"sql": "INSERT INTO nation (n_nationkey, n_name) VALUES (:k, 'ATLANTIS')", "params": {"k": 100 + k // 2}}], who, idempotency_key=_KEY)
    return e.store.read(e.store.current(), "nation")


def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that see each other's writes, committed at once; a second transaction is rolled back."""
    e = _writable(spark, sf_dir, "customer")
    with e.transaction(session()) as t:
        t.statement(1, "DELETE FROM customer WHERE c_acctbal < 0.0")
        t.statement(2, "UPDATE customer SET c_name = 'kept'")
    t = e.transaction(session())
    t.statement(1, "DELETE FROM customer")
    t.rollback()
    return e.sql("SELECT c_custkey, c_name, c_nationkey FROM customer", session())


def rejected_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds that refused statements are refused with."""
    e, rows = engine(spark, sf_dir), []
    for name, sql in _REFUSED.items():
        try:
            e.compile(sql, {}, session())
            rows.append((name, "accepted"))
        except Rejected as x:
            rows.append((name, x.kind.value))
    return spark.createDataFrame(rows, "statement string, refused string")


def explain_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark, sf_dir).explain("SELECT c.c_custkey AS id, o.o_totalprice FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_name LIKE :p LIMIT 9", session())
    rows = [("column", c["name"], c["type"]) for c in out["columns"]] + [("parameter", p["name"], p["type"]) for p in out["parameters"]] + [("resource", r["name"], ",".join(r["columns"])) for r in out["resources"]] + [("limit", "limit", str(out["limit"]))]
    return spark.createDataFrame(rows, "part string, name string, what string")


def visible_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a role may see of the catalog, and how it may use it."""
    out = engine(spark, sf_dir).visible_catalog(session("capped"))
    return spark.createDataFrame([(r["name"], c["name"], c["type"], ",".join(c["usage"])) for r in out["resources"] for c in r["columns"]], "resource string, name string, type string, usage string")


#: name -> a statement outside the language or the role's grants.
_REFUSED = {
    "star": "SELECT * FROM customer", "duplicate_name": "SELECT c_custkey, c_nationkey AS c_custkey FROM customer", "bare_column": "SELECT c_custkey, COUNT(*) AS n FROM customer", "function": "SELECT ABS(c_custkey) AS a FROM customer", "hidden_column": "SELECT c_phone FROM customer",
    "two_statements": "SELECT c_custkey FROM customer; SELECT c_custkey FROM customer", "no_policy": "DELETE FROM orders", "chain": "SELECT c_custkey FROM customer WHERE " + " OR ".join(["c_custkey = 1"] * 400), "redacted_filter": "SELECT event_id FROM events WHERE value > 1.0", "null_literal": "SELECT c_custkey FROM customer WHERE c_name = NULL",
}
_REFUSALS = {"star": "UNSUPPORTED_SQL", "duplicate_name": "DUPLICATE_RESULT_COLUMN", "bare_column": "UNSUPPORTED_SQL", "function": "UNSUPPORTED_SQL", "hidden_column": "FORBIDDEN_COLUMN", "two_statements": "MULTIPLE_STATEMENTS", "no_policy": "MISSING_POLICY", "chain": "LIMIT_EXCEEDED", "redacted_filter": "FORBIDDEN_COLUMN_CONTEXT", "null_literal": "INVALID_PARAMETER"}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(name) for name in SELECTS} | {
    **{f.__name__: f for f in (update_returning, delete_returning, insert_returning, result_envelope, idempotent_replay, transaction_commit, rejected_statements, explain_columns, visible_columns)},
    "insert_preset_returning": insert_preset_returning,
    "update_preset_check": update_preset_check,
    "delete_filtered": delete_filtered,
    "atomic_envelope": atomic_envelope,
}

ORACLE_SQL: dict[str, str] = {name: oracle for name, (_, _, _, oracle) in SELECTS.items() if oracle is not None} | {
    "update_returning": f"SELECT c_custkey::BIGINT AS c_custkey, 'renamed' AS c_name FROM customer WHERE {_C}",
    "delete_returning": f"SELECT c_custkey::BIGINT AS c_custkey FROM customer WHERE {_C}",
    "insert_returning": "SELECT 100::BIGINT AS n_nationkey, 'ATLANTIS' AS n_name UNION ALL SELECT 101::BIGINT, 'LEMURIA'",
    "result_envelope": f"SELECT event_id::BIGINT AS event_id, CASE WHEN user_id <= 40 THEN value END AS value, CASE WHEN user_id <= 40 THEN '' ELSE 'value' END AS redacted FROM events WHERE {_E}",
    "idempotent_replay": "SELECT * FROM nation UNION ALL SELECT 100::INTEGER, 'ATLANTIS', 3::INTEGER UNION ALL SELECT 101::INTEGER, 'ATLANTIS', 3::INTEGER",
    "transaction_commit": f"SELECT c_custkey, 'kept' AS c_name, 7::INTEGER AS c_nationkey FROM customer WHERE {_C} AND c_acctbal >= 0",
    "rejected_statements": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for n, k in _REFUSALS.items()) + ") AS t(statement, refused)",
    "explain_columns": "SELECT * FROM (VALUES ('column', 'id', 'int64'), ('column', 'o_totalprice', 'number'), ('parameter', 'p', 'string'), ('resource', 'customer', 'c_custkey,c_name'), ('resource', 'orders', 'o_custkey,o_totalprice'), ('limit', 'limit', '9')) AS t(part, name, what)",
    "visible_columns": "SELECT * FROM (VALUES ('customer', 'c_custkey', 'int64', 'project,filter,order,group'), ('customer', 'c_name', 'string', 'project,filter,order,group')) AS t(resource, name, type, usage)",
    "insert_preset_returning": "SELECT * FROM nation UNION ALL SELECT 100::INTEGER, 'ATLANTIS', 3::INTEGER UNION ALL SELECT 101::INTEGER, 'LEMURIA', 3::INTEGER",
    "update_preset_check": f"SELECT c_custkey, CASE WHEN {_C} AND c_custkey < 100 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN {_C} AND c_custkey < 100 THEN 7::INTEGER ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "delete_filtered": f"SELECT * FROM customer WHERE NOT ({_C} AND c_acctbal < 2000)",
    "atomic_envelope": f"SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE {_C} AND c_custkey < 100",
}

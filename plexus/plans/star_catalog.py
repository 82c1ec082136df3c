"""A catalog document that describes the star schema's tables, with a few flaws on purpose; and a changed copy of it. Fixed values."""

from __future__ import annotations

import copy

# table -> (columns: (name, type, nullable, default, key position)), foreign keys: (name, columns, table, target columns), indexes: (name, columns, unique, whole, predicate)
TABLES: dict = {
    "region": ([("r_regionkey", "bigint", False, None, 1), ("r_name", "text", True, None, 0)], [], []),
    "nation": (
        [("n_nationkey", "bigint", False, None, 1), ("n_name", "text", True, None, 0), ("n_regionkey", "bigint", True, None, 0)],
        [("nation_region", ["n_regionkey"], "region", ["r_regionkey"])],
        [("nation_by_region", ["n_regionkey", "n_name"], False, True, None)],
    ),
    "customer": (
        [("c_custkey", "bigserial", False, None, 1), ("c_name", "text", True, None, 0), ("c_nationkey", "integer", True, None, 0), ("region_id", "bigint", True, None, 0)],
        [("customer_nation", ["c_nationkey"], "nation", [])],
        [("customer_names", ["c_name"], False, True, None), ("customer_names_again", ["c_name"], False, True, None)],
    ),
    "supplier": (
        [("s_suppkey", "bigint", False, None, 1), ("s_name", "text", True, None, 0), ("s_nationkey", "bigint", True, None, 0)],
        [("supplier_nation", ["s_nationkey"], "nation", ["n_nationkey"])],
        [("supplier_open", ["s_nationkey"], False, True, "s_nationkey > 3")],
    ),
    "part": ([("p_partkey", "bigint", False, None, 1), ("p_name", "text", True, None, 0)], [], [("part_name", ["p_name"], True, True, None)]),
    "orders": (
        [("o_orderkey", "bigint", False, None, 1), ("o_custkey", "bigint", False, None, 0), ("o_orderdate", "date", True, "now()", 0)],
        [("orders_customer", ["o_custkey"], "customer", ["c_custkey"])],
        [("orders_by_customer", ["o_custkey", "o_orderdate"], False, True, None), ("orders_partly", ["o_orderdate"], False, False, None)],
    ),
    "lineitem": (
        [("l_orderkey", "bigint", False, None, 1), ("l_linenumber", "integer", False, None, 2), ("l_partkey", "BIGINT ", True, None, 0), ("l_suppkey", "numeric", True, None, 0)],
        [("lineitem_orders", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem_part", ["l_partkey"], "part", ["p_partkey"]), ("lineitem_supplier", ["l_suppkey"], "supplier", ["s_suppkey"])],
        [("lineitem_part_idx", ["l_partkey"], False, True, None)],
    ),
    "events": ([("event_id", "bigint", True, None, 0), ("user_id", "bigint", True, None, 0), ("event_type", "text", True, None, 0)], [], []),
    "users": ([("id", "bigint", False, None, 1)], [], []),
    "regions": ([("id", "bigint", False, None, 1)], [], []),
}


def document(complete: bool = True) -> dict:
    objects = []
    for name, (columns, fks, indexes) in TABLES.items():
        objects.append(
            {
                "name": name,
                "kind": "table",
                "columns": [{k: v for k, v in {"name": c, "data_type": t, "nullable": n, "default": d, "ordinal": i, "pk_position": p}.items() if v is not None} for i, (c, t, n, d, p) in enumerate(columns, 1)],
                "constraints": [{"name": f, "kind": "foreign-key", "columns": cols, "referenced": {"table": to, "columns": far}} for f, cols, to, far in fks],
                "indexes": [{k: v for k, v in {"name": i, "unique": u, "columns": cols, "definition_complete": whole, "predicate": p, "has_predicate": p is not None}.items() if v is not None} for i, cols, u, whole, p in indexes],
                "triggers": [],
            }
        )
    objects.append({"name": "order_names", "kind": "view", "columns": [{"name": "o_orderkey", "data_type": "bigint", "nullable": True, "ordinal": 1, "pk_position": 0}], "constraints": [], "indexes": [], "triggers": [], "body": "SELECT o_orderkey FROM orders"})
    return {"version": 2, "dialect": "postgres", "producer": {"name": "star"}, "required_features": [], "context": {"source_id": "star", "catalog_complete": complete}, "schemas": [{"name": "main", "objects": objects, "routines": []}], "limitations": []}


def changed_document() -> dict:
    """The document after a migration: a table gone, one new, columns changed, an index and a view's text too."""
    raw = copy.deepcopy(document())
    by_name = {o["name"]: o for o in raw["schemas"][0]["objects"]}
    raw["schemas"][0]["objects"].remove(by_name["part"])
    raw["schemas"][0]["objects"].append({**by_name["regions"], "name": "archive"})
    by_name["nation"]["columns"][1]["data_type"] = "varchar"
    by_name["customer"]["columns"].pop(3)
    by_name["orders"]["columns"].append({"name": "o_status", "data_type": "text", "nullable": False, "ordinal": 4, "pk_position": 0})
    by_name["orders"]["columns"].append({"name": "o_note", "data_type": "text", "nullable": True, "ordinal": 5, "pk_position": 0})
    by_name["supplier"]["columns"][1]["nullable"] = False
    by_name["region"]["indexes"].append({"name": "region_name", "unique": True, "columns": ["r_name"], "definition_complete": True})
    by_name["order_names"]["body"] = "SELECT o_orderkey FROM orders WHERE o_orderkey > 0"
    by_name["lineitem"]["constraints"].pop()
    return raw


def values(rows: list[tuple], names: str) -> str:
    """A SQL VALUES list; lists become list literals."""

    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, int):
            return str(x)
        if isinstance(x, list):
            return f"CAST([{', '.join(map(one, x))}] AS VARCHAR[])"
        return "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


def sql_tables() -> dict[str, str]:
    """The same metadata as SQL: columns, fks, indexes."""
    cols = [(f"main.{t}", f"main.{t}.{c}", c, kind, n, d, i, p) for t, (columns, _, _) in TABLES.items() for i, (c, kind, n, d, p) in enumerate(columns, 1)]
    fks = [(f"main.{t}.{f}", f"main.{t}", [f"main.{t}.{c}" for c in own], f"main.{to}", [f"main.{to}.{c}" for c in far]) for t, (_, keys, _) in TABLES.items() for f, own, to, far in keys]
    idx = [(f"main.{t}.{i}", f"main.{t}", [f"main.{t}.{c}" for c in own], u, whole, p is not None) for t, (_, _, indexes) in TABLES.items() for i, own, u, whole, p in indexes]
    return {
        "cols": values(cols, "table_id, column_id, name, data_type, nullable, dflt, ordinal, pk"),
        "fks": values(fks, "fk_id, table_id, cols, target_id, far"),
        "idx": values(idx, "index_id, table_id, cols, uniq, whole, filtered"),
    }

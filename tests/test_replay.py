"""Replayed schemas against a fold over the events, on random histories."""

import random

import pytest

from larkspur.operators import replay

SCHEMA = "db string, file string, location int, action string, table string, column string, type string, new_name string, columns array<string>, to_table string, options map<string,string>, part string"


def fold(events):
    """(db, kind, table, position, name, type, nullable, default, columns, unique, to_table, primary_key) by one event after the other."""
    dbs = {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        db, _, _, action, table, column, kind, new, columns, to, options, part = e
        o, tables = options or {}, dbs.setdefault(db, {})
        if part in ("down", "revert") or not table:
            continue
        if action == "create_table":
            if table not in tables:
                tables[table] = {"columns": [], "index": [], "foreign_key": []}
                if o.get("id") != "false" and "," not in (o.get("primary_key") or ""):
                    tables[table]["columns"].append([o.get("primary_key") or "id", o.get("id") if o.get("id") not in (None, "true") else "bigint", False, o.get("default"), "true"])
        elif table not in tables:
            continue
        elif action == "drop_table":
            del tables[table]
        elif action == "rename_table":
            if new is not None and new != table:
                tables[new] = tables.pop(table)
        else:
            t = tables[table]

            def add(name, kind, nullable=True, default=None, t=t):
                t["columns"] = [c for c in t["columns"] if c[0] != name] + [[name, kind, nullable, default, None]]

            found = next((c for c in t["columns"] if c[0] == column), None)
            if action == "add_column" and column is not None:
                add(column, kind, o.get("null") != "false", o.get("default"))
            elif action == "add_reference":
                add(f"{column}_id", kind or "bigint", o.get("null") != "false", o.get("default"))
            elif action == "add_timestamps":
                add("created_at", "datetime", o.get("null") != "false", o.get("default"))
                add("updated_at", "datetime", o.get("null") != "false", o.get("default"))
            elif action == "remove_column":
                t["columns"] = [c for c in t["columns"] if c[0] != column]
            elif action == "remove_reference":
                t["columns"] = [c for c in t["columns"] if c[0] != f"{column}_id"]
            elif action == "rename_column" and found and new is not None and new != column:
                t["columns"] = [c for c in t["columns"] if c[0] != new]
                found[0] = new
            elif action == "change_column" and found and kind:
                found[1] = kind
            elif action == "change_column_default" and found and "to" in o:
                found[3] = o["to"]
            elif action == "change_column_null" and found and o.get("null") is not None:
                found[2] = o["null"] != "false"
            elif action == "add_index" and columns:
                t["index"].append([o.get("name"), columns, o.get("unique") == "true"])
            elif action == "add_foreign_key":
                t["foreign_key"].append([o.get("column") or f"{to.removesuffix('s')}_id", to, o.get("primary_key") or "id"])
    out = []
    for db, tables in dbs.items():
        for name, t in tables.items():
            out += [(db, "column", name, i, *c[:4], None, None, None, c[4]) for i, c in enumerate(t["columns"])]
            out += [(db, "index", name, i, x[0], None, None, None, x[1], x[2], None, None) for i, x in enumerate(t["index"])]
            out += [(db, "foreign_key", name, i, x[0], None, None, None, None, None, x[1], x[2]) for i, x in enumerate(t["foreign_key"])]
    return sorted(map(str, out))


ACTIONS = [("create_table", 5), ("drop_table", 2), ("rename_table", 5), ("add_column", 8), ("rename_column", 6), ("remove_column", 3), ("change_column", 3), ("change_column_default", 3), ("change_column_null", 3), ("add_reference", 2), ("remove_reference", 1), ("add_timestamps", 1), ("add_index", 2), ("add_foreign_key", 2)]


def history(rng, db, n):
    tables, columns, out = ["a", "b", "c"], ["x", "y", "z", "id", "y_id"], []
    for i in range(n):
        action = rng.choices([a for a, _ in ACTIONS], [w for _, w in ACTIONS])[0]
        options = {}
        if rng.random() < 0.4:
            options = {k: rng.choice(v) for k, v in (("null", ["true", "false"]), ("default", ["1", "2"]), ("to", ["7", None]), ("unique", ["true", "false"])) if rng.random() < 0.6}
        if action == "create_table" and rng.random() < 0.5:
            options |= rng.choice([{"id": "false"}, {"id": "uuid"}, {"primary_key": "x"}, {"primary_key": "x,y"}, {"id": "true"}])
        new = rng.choice(tables if action == "rename_table" else columns) if "rename" in action and rng.random() < 0.95 else None
        out.append((db, str(i // 7).zfill(3), i, action, rng.choice(tables), rng.choice(columns), rng.choice(["int", "text", None]) if action == "change_column" else rng.choice(["int", "text"]), new, [rng.choice(columns)] if rng.random() < 0.8 else None, "teams", options or None, rng.choice(["up", None, None, "change", "down"]) if rng.random() < 0.3 else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_the_fold_on_random_histories(spark, seed):
    rng = random.Random(seed)
    events = [e for i in range(40) for e in history(rng, f"d{i}", rng.choice([3, 10, 30, 80]))]
    rng.shuffle(events)
    got = sorted(str(tuple(r)) for r in replay.replay_schema(spark.createDataFrame(events, SCHEMA)).collect())
    assert got == fold(events)


def test_long_chains_and_empty_histories(spark):
    n = 40
    chain = [("d", "0", 0, "create_table", "t0", None, None, None, None, None, None, None), ("d", "0", 1, "add_column", "t0", "c0", "int", None, None, None, None, None)]
    for i in range(n):
        chain.append(("d", "1", 2 * i, "rename_table", f"t{i}", None, None, f"t{i + 1}", None, None, None, None))
        chain.append(("d", "1", 2 * i + 1, "rename_column", f"t{i + 1}", f"c{i}", None, f"c{i + 1}", None, None, None, None))
    frame = spark.createDataFrame(chain, SCHEMA)
    assert sorted(str(tuple(r)) for r in replay.replay_schema(frame).collect()) == fold(chain)
    assert {(r.table, r.column) for r in replay.replay(frame).collect()} == {(f"t{n}", "id"), (f"t{n}", f"c{n}")}
    assert replay.replay_schema(frame.limit(0)).count() == 0
    nothing = [("d", "0", 0, "create_table", None, None, None, None, None, None, None, None), ("d", "0", 1, "rename_table", "a", None, None, "b", None, None, None, None), (None, "0", 1, "create_table", "", None, None, None, None, None, None, None)]
    assert replay.replay_schema(spark.createDataFrame(nothing, SCHEMA)).count() == 0

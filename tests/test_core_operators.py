"""Record shredding, edges included."""

from __future__ import annotations

import json

import pytest

from skeinworks.operators import shred


CASES = [
    ({"blocks": [{"metadata": {"objects": [{"name": "a", "contents": {"name": "b"}}, None, {"name": "c"}]}}, None]}, {("block", "0"), ("object", "0.0"), ("object", "0.0.0"), ("object", "0.2")}),
    ({"blocks": {"2": {"text": "x"}, "0": {"text": "y"}}}, {("block", "2"), ("block", "0")}),
    ({"blocks": {"text": "lone"}}, {("block", "0")}),
    ({"blocks": json.dumps([{"metadata": json.dumps({"a": {"objects": {"1": {"n": 1}}}})}])}, {("block", "0"), ("object", "0.1")}),
    ({"record": {"env": "e", "leakage_flags": ["text", {"evidence": {"block": 1}}, {"evidence": [None, {"b": 2}, "s"]}, None]}}, {("flag", "0"), ("flag", "1"), ("flag", "2"), ("evidence", "1.0"), ("evidence", "2.1"), ("evidence", "2.2")}),
    ({"goal": "no blocks", "blocks": None, "leakage_flags": []}, set()),
    ({"other": 1}, set()),
    ([1, 2], set()),
    ({"blocks": [{"metadata": {"objects": ["text", 5, [], {"contents": [[], {"x": 1}]}]}}]}, {("block", "0"), ("object", "0.3"), ("object", "0.3.1")}),
]


@pytest.mark.parametrize("record, expected", CASES)
def test_children_of_shapes(spark, record, expected):
    df = spark.createDataFrame([(1, json.dumps(record))], "line_no long, raw string")
    got = [(r["child"], r["child_path"]) for r in shred.children(shred.adjacency(df)).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_shred_edges(spark):
    long = {"blocks": [{"text": "x" * 2_000_000, "type": "Goal", "step": 1, "metadata": {}}]}
    raws = [None, "", "  ", "{", "null", "5", '"text"', json.dumps(long), json.dumps(long), "[" * 5000]
    df = spark.createDataFrame([(None if i == 8 else 3 if i in (7, 9) else i, r, "clash", 1) for i, r in enumerate(raws)], "line_no long, raw string, path string, node int")
    nodes = shred.adjacency(df)
    assert [(r["line_no"], r["child"]) for r in shred.children(nodes).orderBy("line_no").collect()] == [(None, "block"), (3, "block")]
    blocks = shred.entity_table(nodes, shred.entity_paths(nodes), *shred.TABLES["blocks"]).collect()
    assert len(blocks) == 1 and len(blocks[0]["text"]) == 2_000_000 and blocks[0]["step"] == "1"
    empty = df.filter("false")
    assert {name: t.count() for name, t in shred.flat_tables(empty).items()} == {name: 0 for name in [*shred.TABLES, "rest"]}


def test_flat_tables_keep_their_parents(spark):
    record = {"trajectory_id": "t", "goal": {"text": "g"}, "blocks": [{"type": "Goal", "metadata": {"scene": {"room": "r", "objects": [{"name": "a", "state": {"temp": 1.5}, "contents": [{"name": "b", "state": "on"}]}]}}}], "leakage_flags": [{"type": "k", "evidence": [{"block": 3, "span": [1, 9]}]}]}
    t = {k: v.collect() for k, v in shred.flat_tables(spark.createDataFrame([(7, json.dumps(record))], "line_no long, raw string")).items()}
    assert t["trajectories"][0]["goal_text"] == "g" and t["blocks"][0]["metadata_scene_room"] == "r"
    objects = {r["name"]: r for r in t["objects"]}
    assert objects["a"]["parent_path"] == "0" and objects["b"]["parent_path"] == "0.0" and objects["a"]["state_temp"] == "1.5" and objects["b"]["state"] == "on"
    assert t["evidence"][0]["span_1"] == "9" and t["evidence"][0]["parent_path"] == "0"


def test_lines_with_one_number_stay_apart(spark):
    raws = [{"blocks": [{"text": t, "metadata": {"objects": [{"name": t, "contents": [{"name": t + t}]}]}}]} for t in "ab"]
    t = shred.flat_tables(spark.createDataFrame([(3, json.dumps(r)) for r in raws], "line_no long, raw string"))
    assert sorted(r["text"] for r in t["blocks"].collect()) == ["a", "b"]
    assert sorted((r["path"], r["name"]) for r in t["objects"].collect()) == [("0.0", "a"), ("0.0", "b"), ("0.0.0", "aa"), ("0.0.0", "bb")]


def test_deep_text(spark):
    """Deeper than the interpreter recurses: read like any other."""
    for text in ('{"a": [1, -2.5e3, "x\\"]", null, true, {}, [], {"b": {"c": []}}]}', " [ ] ", '"s"', "3"):
        assert shred.read_deep(text) == json.loads(text)
    for text in ("", "[", "[1,]", '{"a" 1}', "{1: 2}", "[1] 2", '{"a": 1', "[1 2]", "nul"):
        with pytest.raises(ValueError):
            shred.read_deep(text)
    n = 12_000
    raw = '{"blocks": [{"metadata": ' + '{"objects": [' * n + "]}" * n + "}]}"
    wide = spark.createDataFrame([(1, raw), (2, "[" * n)], "line_no long, raw string")
    got = shred.children(shred.adjacency(wide)).groupBy("child").count().collect()
    assert {r["child"]: r["count"] for r in got} == {"block": 1, "object": n - 1}


def test_round_trip_of_a_table(spark, folder):
    """Scalars of the lines, by a walk of its own, are those of the flat tables and the rest, none lost and none new."""
    from collections import Counter

    import duckdb

    def said(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def scalars(v, place):
        if place in ("blocks", "metadata"):
            v = said(v)
        if isinstance(v, dict):
            for k, x in v.items():
                yield from scalars(x, {"record": {"blocks": "blocks"}, "block": {"metadata": "metadata"}}.get(place, {}).get(k, "other"))
        elif isinstance(v, list):
            for x in v:
                yield from scalars(x, "block" if place == "blocks" else "other")
        elif v is not None:
            yield v if isinstance(v, str) else json.dumps(v)

    want = Counter()
    for line, raw in duckdb.sql(f"SELECT line_no, raw FROM '{folder}/raw_trajectories.parquet'").fetchall():
        record = shred.record_of(raw)
        if record is not None:
            # A lone block and blocks keyed by numbers are lists.
            blocks = said(record.get("blocks"))
            if isinstance(blocks, dict):
                record["blocks"] = [x for _, x in shred.elements(blocks)]
            want.update((line, s) for s in scalars(record, "record"))
    tables = {k: v.collect() for k, v in shred.flat_tables(spark.read.parquet(f"{folder}/raw_trajectories.parquet")).items()}
    got = Counter((r["line_no"], r["scalar"]) for r in tables.pop("rest"))
    got.update((r["line_no"], v) for rows in tables.values() for r in rows for k, v in r.asDict().items() if v is not None and k not in ("line_no", "path", "parent_path", "ordinal"))
    assert got == want and len(want) > 100


def test_no_scalar_is_lost(spark):
    """Every scalar of a record is in a column of a flat table or a row of the rest."""
    agent = {"name": "n", "model": {"size": "7b", "temp": 0.2, "seed": 4}}
    record = {"trajectory_id": "t", "score": 1, "goal": {"text": "g", "by": "z"}, "blocks": [{"type": "Goal", "text": "x", "metadata": {"agent": agent, "objects": ["lamp", "desk", {"name": "a", "mass": 2.5}]}}, "bare"], "leakage_flags": [{"type": "k", "sure": True, "evidence": [{"block": 3, "span": [1, 9, 11]}]}]}
    lines = spark.createDataFrame([(7, json.dumps(record))], "line_no long, raw string")
    tables = {k: v.collect() for k, v in shred.flat_tables(lines).items()}
    block = next(r for r in tables["blocks"] if r["path"] == "0")
    assert (block["metadata_agent_model_size"], block["metadata_agent_model_temp"]) == ("7b", "0.2")
    left = sorted(((r["entity"], r["path"], r["field"], r["scalar"]) for r in tables.pop("rest")), key=lambda r: tuple(map(str, r)))
    assert left == sorted([
        ("trajectory", None, "score", "1"), ("trajectory", None, "goal.by", "z"), ("block", "0", "metadata.agent.model.seed", "4"), ("block", "0", "metadata.objects", "lamp"),
        ("block", "0", "metadata.objects", "desk"), ("object", "0.2", "mass", "2.5"), ("flag", "0", "sure", "true"), ("evidence", "0.0", "span.2", "11"),
    ], key=lambda r: tuple(map(str, r)))
    held = [v for rows in tables.values() for r in rows for k, v in r.asDict().items() if v is not None and k not in ("line_no", "path", "parent_path", "ordinal")]
    scalars = shred.shred(lines).filter("scalar IS NOT NULL").count()
    assert len(held) + len(left) == scalars


def test_children_agree_with_a_recursive_walk(spark, folder):
    import duckdb

    def items(v):
        if v is None:
            return []
        if isinstance(v, list):
            return list(enumerate(v))
        return [(int(k), x) for k, x in v.items()] if isinstance(v, dict) and v and all(k.isdigit() for k in v) else [(0, v)]

    def said(v):
        try:
            return json.loads(v) if isinstance(v, str) else v
        except ValueError:
            return v

    def scan(v, path, line, out):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            if k in ("objects", "contents"):
                for i, o in items(x):
                    if isinstance(o, dict):
                        out.add((line, "object", f"{path}.{i}"))
                        scan(o, f"{path}.{i}", line, out)
            else:
                scan(x, path, line, out)

    out = set()
    for line, raw in duckdb.sql(f"SELECT line_no, raw FROM '{folder}/raw_trajectories.parquet'").fetchall():
        try:
            record = json.loads(raw or "")
        except ValueError:
            continue
        record = record.get("record", record) if isinstance(record, dict) else {}
        for i, b in items(said(record.get("blocks"))):
            if b is not None:
                out.add((line, "block", str(i)))
                scan(said(b.get("metadata")), str(i), line, out)
        for i, f in items(record.get("leakage_flags")):
            if f is not None:
                out.add((line, "flag", str(i)))
                for j, e in items(f.get("evidence")) if isinstance(f, dict) else ():
                    if e is not None:
                        out.add((line, "evidence", f"{i}.{j}"))
    got = shred.children(shred.adjacency(spark.read.parquet(f"{folder}/raw_trajectories.parquet"))).collect()
    assert {tuple(r) for r in got} == out and len(got) == len(out)

"""Deeply nested records as an adjacency table, and flat tables made from it.

``shred`` stores every value of a record as a row: ``record`` (the number of its
line among those read), ``node`` (its number in the record), ``parent``,
``label`` (key), ``ordinal`` (position in a list), ``kind`` and ``scalar``. Nodes
that are children in the sense of the data model have their ``entity``
(trajectory, block, object, flag, evidence); every node knows the next entity
above it (``owner``), and scalars their field name there. ``entity_paths`` joins
entities with the ones above them, twice as far each time, until the paths are
whole. ``entity_table`` joins the nodes of an entity with its scalars and pivots
them into columns; ``rest`` has a row for each scalar that no column takes.

A line is one JSON value, alone or in a ``record`` wrapper, however deep it is.
Lines that are null, blank or no valid JSON, and values without any field of a
record, give no rows; ``line_no`` is kept as it is, null or repeated. A lone
value in place of a list is its element 0, an object keyed by numbers is a list
at these positions, JSON text in place of ``blocks`` or ``metadata`` is what it
says. Nulls keep their position and are no children; empty lists have none. Of
a key that stands twice in one object the last value holds. An empty table has
no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import stash

FIELDS = {"trajectory_id", "env", "split", "goal", "blocks", "leakage_flags"}
NODES = [
    ("node", "int"), ("parent", "int"), ("label", "string"), ("ordinal", "int"), ("kind", "string"), ("scalar", "string"),
    ("entity", "string"), ("owner", "int"), ("field", "string"),
]
#: Keys under which a block's metadata has scene objects (fixed values).
OBJECT_KEYS = {"objects", "contents"}
CHILDREN = ["block", "object", "flag", "evidence"]
#: Places that hold lists, and the entity of their elements.
LISTS = {"blocks": "block", "flags": "flag", "pieces": "evidence", "objects": "object"}


BLANK = re.compile(r"[ \t\n\r]*")


def read_deep(text: str):
    """The value of JSON text that is nested deeper than the interpreter can recurse."""
    atom = json.JSONDecoder().raw_decode
    blank = lambda i: BLANK.match(text, i).end()
    top: list = []
    # Containers that are open, each with the key that its next value gets.
    open_: list[tuple[list | dict, str | None]] = [(top, None)]
    i = blank(0)
    try:
        while True:
            here, key = open_.pop()
            if text[i] in "[{":
                value: list | dict = [] if text[i] == "[" else {}
                i = blank(i + 1)
            else:
                value, i = atom(text, i)
            if isinstance(here, list):
                here.append(value)
            else:
                here[key] = value
            open_.append((here, None))
            if isinstance(value, (list, dict)):
                open_.append((value, None))
                if text[i] in "]}":
                    fresh = True
                else:
                    fresh = False
                    if isinstance(value, dict):
                        i, key = key_at(text, i, atom, blank)
                        open_[-1] = (value, key)
            else:
                fresh = True
            while fresh:
                i = blank(i)
                if len(open_) == 1:
                    if i != len(text):
                        raise ValueError("more than one value")
                    return top[0]
                here = open_[-1][0]
                if text[i] == ("]" if isinstance(here, list) else "}"):
                    open_.pop()
                    i += 1
                    continue
                if text[i] != ",":
                    raise ValueError("no comma")
                i, key = blank(i + 1), None
                if isinstance(here, dict):
                    i, key = key_at(text, i, atom, blank)
                open_[-1] = (here, key)
                fresh = False
    except IndexError:
        raise ValueError("the text ends too early") from None


def key_at(text: str, i: int, atom, blank) -> tuple[int, str]:
    """Where the value after the key at ``i`` begins, and the key."""
    if text[i] != '"':
        raise ValueError("no key")
    key, i = atom(text, i)
    i = blank(i)
    if text[i] != ":":
        raise ValueError("no colon")
    return blank(i + 1), key


def read_json(text: str):
    try:
        return json.loads(text)
    except RecursionError:
        return read_deep(text)


def parsed(value):
    """What JSON text in a string says, be it wrapped more than once; a string that says none is itself."""
    while isinstance(value, str):
        try:
            said = read_json(value)
        except ValueError:
            return value
        if said is not None and not isinstance(said, (dict, list, str)):
            return value
        value = said
    return value


def elements(value) -> list[tuple[int, object]]:
    """Positions and elements of a list in any of its shapes."""
    if value is None:
        return []
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict) and all(k.isdecimal() for k in value):
        return sorted(((int(k), v) for k, v in value.items()), key=lambda e: e[0])
    return [(0, value)]


def record_of(raw: str | None) -> dict | None:
    """The record of a line, or None."""
    try:
        value = read_json(raw) if raw else None
    except ValueError:
        return None
    while isinstance(value, dict) and not FIELDS & value.keys() and isinstance(value.get("record"), (dict, str)):
        value = parsed(value["record"])
    return value if isinstance(value, dict) and FIELDS & value.keys() else None


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return {bool: "boolean", str: "string"}.get(type(value), "number")


def nodes_of(record: dict) -> Iterator[tuple]:
    """The rows of one record, parents before children; no recursion, however deep it is."""
    # What is still to be visited: value, parent, label, ordinal, where it stands, entity, owner, field.
    todo: list[tuple] = [(record, None, None, None, "record", "trajectory", None, "")]
    number = 0
    while todo:
        value, parent, label, ordinal, place, entity, owner, field = todo.pop()
        node, number = number, number + 1
        if place in ("blocks", "metadata"):
            value = parsed(value)
        kind = kind_of(value)
        nested = kind in ("object", "array")
        scalar = None if nested or value is None else value if kind == "string" else json.dumps(value)
        yield node, parent, label, ordinal, kind, scalar, entity, owner, field
        if entity:
            owner, field = node, ""
        below = []
        if place in LISTS:
            child = LISTS[place]
            for at, v in elements(value):
                counts = v is not None and (child != "object" or isinstance(v, dict))
                below.append((v, node, None, at, child if counts else "other", child if counts else None, owner, field))
        elif kind == "object":
            for key, v in value.items():
                inside = {"record": {"blocks": "blocks", "leakage_flags": "flags"}, "block": {"metadata": "metadata"}, "flag": {"evidence": "pieces"}}.get(place, {}).get(key, "other")
                if place in ("metadata", "object", "scene"):
                    inside = "objects" if key in OBJECT_KEYS else "scene"
                below.append((v, node, key, None, inside, None, owner, f"{field}.{key}" if field else key))
        elif kind == "array":
            inside = "scene" if place in ("metadata", "object", "scene") else "other"
            below = [(v, node, None, i, inside, None, owner, f"{field}.{i}" if field else str(i)) for i, v in enumerate(value)]
        todo.extend(reversed(below))


def shred(lines: DataFrame, line: str = "line_no", raw: str = "raw") -> DataFrame:
    """The adjacency table of the records in ``raw``, one pass over the lines without a shuffle."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int32() if t == "int" else pa.string() for _, t in NODES]
        names = [line, "record", *[n for n, _ in NODES]]
        for batch in batches:
            kind, numbers, records, held = batch.column(0).type, [], [], []

            def flush():
                columns = zip(*held) if held else [[] for _ in NODES]
                return pa.record_batch([pa.array(numbers, kind), pa.array(records, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

            for number, text, place in zip(*(batch.column(k).to_pylist() for k in range(3))):
                record = record_of(text)
                for node in nodes_of(record) if record is not None else ():
                    held.append(node)
                    numbers.append(number)
                    records.append(place)
                    if len(held) >= 50_000:
                        yield flush()
                        numbers, records, held = [], [], []
            yield flush()

    number = lines.schema[line].dataType.simpleString()
    read = lines.select(line, raw, F.monotonically_increasing_id().alias("record"))
    return read.mapInArrow(rows, f"`{line}` {number}, record long, " + ", ".join(f"{n} {t}" for n, t in NODES))


def adjacency(lines: DataFrame, line: str = "line_no", raw: str = "raw") -> DataFrame:
    """``shred``, written to the shared folder: lines are parsed once for all tables, and numbers of records stay."""
    return stash(shred(lines, line, raw), "nodes")


def entity_paths(nodes: DataFrame, line: str = "line_no") -> DataFrame:
    """``line, record, node, entity, ordinal, path`` of every entity; ``nodes`` must be written (``adjacency``).

    An entity is joined with the one above it, which brings its path so far and where that leads: each round doubles
    the length of the paths.
    """
    at = nodes.filter("entity IS NOT NULL").select(
        line, "record", "node", "entity", "ordinal", F.nullif("owner", F.lit(0)).alias("up"), F.when(F.col("entity") != "trajectory", F.col("ordinal").cast("string")).alias("path")
    )
    while True:
        above = at.select(F.col("record").alias("_record"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = at.join(above, (at["record"] == above["_record"]) & (at["up"] == above["_node"]), "left")
        path = F.when(F.col("path").isNotNull(), F.concat_ws(".", "_path", "path"))
        at = stash(joined.select(line, "record", "node", "entity", "ordinal", F.col("_up").alias("up"), path.alias("path")), "paths")
        if at.filter("up IS NOT NULL").isEmpty():
            return at.drop("up")


def children(nodes: DataFrame, line: str = "line_no") -> DataFrame:
    """``child`` and ``child_path`` of every block, object, flag and piece of evidence."""
    return entity_paths(nodes, line).filter(F.col("entity").isin(CHILDREN)).select(line, F.col("entity").alias("child"), F.col("path").alias("child_path"))


def owned_scalars(nodes: DataFrame) -> DataFrame:
    """The scalars with the entity they belong to; that of an entity without fields is its own, with the field ``""``."""
    of = F.when(F.col("entity").isNotNull(), F.col("node")).otherwise(F.col("owner"))
    field = F.when(F.col("entity").isNotNull(), F.lit("")).otherwise(F.col("field"))
    return nodes.filter("scalar IS NOT NULL").select(F.col("record").alias("_record"), of.alias("_owner"), F.col("node").alias("_node"), field.alias("field"), F.col("ordinal").alias("_ordinal"), "kind", "scalar")


def entity_table(nodes: DataFrame, paths: DataFrame, entity: str, fields: list[str], line: str = "line_no") -> DataFrame:
    """One row per node of ``entity``: ``path``, ``parent_path``, ``ordinal``, its own ``value`` where it is a scalar, and ``fields``.

    Rows whose ``line_no`` is null take no part, as nothing links them. Both sides are partitioned by record and node,
    and the pivot keeps that partitioning: the join and the aggregation share one shuffle.
    """
    here = paths.filter((F.col("entity") == entity) & F.col(line).isNotNull()).drop("entity")
    scalars = owned_scalars(nodes).filter(F.col("field").isin(["", *fields]))
    joined = here.join(scalars, (here["record"] == scalars["_record"]) & (here["node"] == scalars["_owner"]), "left")
    columns = [F.max(F.when(F.col("field") == f, F.col("scalar"))).alias(f.replace(".", "_")) for f in fields]
    value = F.max(F.when(F.col("field") == "", F.col("scalar"))).alias("value")
    rows = joined.groupBy("record", "node").agg(F.first(line).alias(line), F.first("path").alias("path"), F.first("ordinal").alias("ordinal"), value, *columns)
    parent = F.nullif(F.regexp_replace(F.coalesce("path", F.lit("")), r"\.?\d+$", ""), F.lit(""))
    return rows.select(line, "path", parent.alias("parent_path"), "ordinal", "value", *[f.replace(".", "_") for f in fields])


#: The flat tables: entity and the scalar fields that become columns.
TABLES = {
    "trajectories": ("trajectory", ["trajectory_id", "env", "split", "goal", "goal.text", "goal.lang"]),
    "blocks": ("block", ["step", "type", "text", "metadata.ms", "metadata.agent", "metadata.agent.name", "metadata.agent.model.size", "metadata.agent.model.temp", "metadata.scene.room"]),
    "objects": ("object", ["name", "kind", "state", "state.temp", "state.open"]),
    "flags": ("flag", ["type", "step"]),
    "evidence": ("evidence", ["block", "span.0", "span.1"]),
}


def rest(nodes: DataFrame, paths: DataFrame, line: str = "line_no") -> DataFrame:
    """The scalars that are in no column of ``TABLES``: the ``entity`` and ``path`` that own them, ``node``, ``field``, ``ordinal``, ``kind`` and ``scalar``.

    As in ``entity_table``, rows whose ``line_no`` is null take no part.
    """
    owners = paths.filter(F.col(line).isNotNull()).select(line, "record", F.col("node").alias("_of"), "entity", "path")
    scalars = owned_scalars(nodes).filter("field <> ''")
    joined = scalars.join(owners, (scalars["_record"] == owners["record"]) & (scalars["_owner"] == owners["_of"]))
    taken = F.lit(False)
    for entity, fields in TABLES.values():
        taken = taken | ((F.col("entity") == entity) & F.col("field").isin(fields))
    return joined.filter(~taken).select(line, "entity", "path", F.col("_node").alias("node"), "field", F.col("_ordinal").alias("ordinal"), "kind", "scalar")


def flat_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """All flat tables and the ``rest``, from one parse; ``line_no`` and ``parent_path`` link a child to its parent."""
    nodes = adjacency(lines)
    paths = entity_paths(nodes)
    return {**{name: entity_table(nodes, paths, entity, fields) for name, (entity, fields) in TABLES.items()}, "rest": rest(nodes, paths)}

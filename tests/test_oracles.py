"""Every query that has SQL gives what DuckDB gives."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from skeinworks.plans import nested, reference

ORACLES = {**reference.oracle_sql(), **nested.oracle_sql()}
QUERIES = {**reference.queries(), **nested.queries()}


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, folder, duck, name):
    ours, theirs = QUERIES[name](spark, folder).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs) > 0
    assert rows_of(ours) == rows_of(theirs)


def test_flagship_anchor(spark, folder):
    row = QUERIES["budget_suffix_v2"](spark, folder).collect()[0]
    assert row["goal"] == 0 and abs(row["rate"] - 0.2) < 0.001


def test_rest_works_without_the_subpackage(tmp_path):
    """In a copy without its two folders the entry point imports, and no module of the rest misses anything."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(reference.__file__).parents[2]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    every = sorted(p.relative_to(copy).with_suffix("").as_posix().replace("/", ".").removesuffix(".__init__") for p in (copy / "skeinworks").rglob("*.py"))
    code = f"import importlib, __spark_entry__ as e\nfor m in {every!r}: importlib.import_module(m)\nprint(len(e.queries()), len(e.oracle_sql()), sum(q.startswith(('p1_', 'p3_')) for q in e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    queries, oracles, dealt = map(int, run.stdout.split())
    assert queries == len(QUERIES) and oracles == len(ORACLES) and not dealt

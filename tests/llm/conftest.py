from __future__ import annotations

import datetime as dt

import pytest

AT = dt.datetime(2031, 1, 1)
BLOCKS = "array<struct<step:int,type:string,text:string,metadata:map<string,string>>>"
#: Columns whose names the operators use inside, to clash with them.
CLASH = {"key": "x", "copy": "y", "term": "z", "n": 1, "row": 2, "tokens": 3, "text_": "t", "component": "c", "block": 5, "prob": 0.5, "kind": "k", "value": 9, "place": 1, "word": "w", "grade": 3}


def with_clash(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns})


@pytest.fixture(scope="session")
def make(spark):
    """Tables from rows; trajectories as (traj_no, trajectory_id, env, split, goal, blocks, loaded_at)."""

    class Make:
        def trajectories(self, rows):
            full = []
            for r in rows:
                no, tid, env, split, goal, blocks, *at = r
                blocks = None if blocks is None else [(b if len(b) == 4 else (*b, None)) for b in blocks]
                full.append((no, tid, env, split, goal, blocks, None, at[0] if at else AT))
            return with_clash(spark.createDataFrame(full, f"traj_no long, trajectory_id string, env string, split string, goal string, blocks {BLOCKS}, leakage_flags string, loaded_at timestamp_ntz"))

        def log(self, rows):
            return with_clash(spark.createDataFrame(rows, "event_no long, trajectory_id string, seq int, block_step int, block_type string, block_text string, logged_at timestamp_ntz, arrived_at timestamp_ntz"))

        def documents(self, rows):
            full = [(r + (None,) * 5)[:5] for r in rows]
            return with_clash(spark.createDataFrame(full, "doc_id long, text string, source string, lang string, env string"))

    return Make()

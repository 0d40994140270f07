"""The stream gives what a batch over the same files gives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skeinworks.streaming import ingest


def test_budget_of_a_stream(spark, tmp_path):
    def line(no, day, words):
        blocks = [{"step": 0, "type": "Goal", "text": "do it"}, {"step": 1, "type": "Action", "text": " ".join(["go"] * words)}]
        return json.dumps({"traj_no": no, "loaded_at": f"2031-01-0{day}T00:00:00", "split": "Train", "blocks": blocks, "leakage_flags": []})

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([line(1, 1, 10), line(2, 1, 20)]) + "\n")
    (folder / "b.jsonl").write_text("\n".join([line(2, 2, 20), line(3, 2, 30), ""]) + "\n")
    rows = ingest.arriving_examples(ingest.arriving(spark, str(folder), files_per_batch=1))
    budget = ingest.running_budget(rows, "suffix", F.lit(0.5))
    q = budget.writeStream.outputMode("complete").format("memory").queryName("budget").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    (r,) = spark.table("budget").collect()
    assert (r["split"], r["trajectories"], r["action"], r["goal"]) == ("train", 3, 30, 0)

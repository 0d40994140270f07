"""Sources, the micro-fixture of masks, sampling and aggregates, worked by hand."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from skeinworks.functions import schedules
from skeinworks.functions.draws import uniform
from skeinworks.operators import batches, examples, losses, masks, names, sampling, vocabulary
from skeinworks.sources import documents, trajectories

BTYPE = [1, 1, 2, 3, 4, 4, 2, 3, 4, 4]
STEP = [0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
BIDX = [0, 0, 1, 2, 3, 3, 4, 5, 6, 6]
TOK = "array<struct<pos:int,token:string,btype:int,step:int,bidx:int,id:int>>"


def example(spark, btype=BTYPE, step=STEP, bidx=BIDX, traj_no=1):
    tok = [(i, f"w{i}", b, s, x, 10 + i) for i, (b, s, x) in enumerate(zip(btype, step, bidx))]
    return spark.createDataFrame([(traj_no, "train", tok, len(tok))], f"traj_no long, split string, tok {TOK}, n int")


def masked(rows):
    r = rows.collect()[0]
    on = lambda flags: [i for i, b in enumerate(flags) if b]
    return on(r["tgt"]), on(r["ctx"])


@pytest.mark.parametrize(
    "name, target, context",
    [
        ("suffix", [8, 9], [*range(8)]),
        ("retrodiction", [2, 3], [0, 1, *range(4, 10)]),
        ("next_obs", [8, 9], [*range(8)]),
    ],
)
def test_fixed_masks_of_the_second_generation(spark, name, target, context):
    assert masked(masks.with_mask_v2(example(spark), name, F.lit(0.2))) == (target, context)


def test_masks_with_one_choice(spark):
    one = example(spark)
    assert masked(masks.with_mask_v1(one, "future_from_past", F.lit(0.2))) == ([6, 7, 8, 9], [0, 1, 2, 3, 4, 5])
    assert masked(masks.with_mask_v1(one, "retrodiction", F.lit(0.2))) == ([2, 3, 4, 5], [6, 7, 8, 9])


@pytest.mark.parametrize("seed", range(6))
def test_drawn_masks_obey_their_definitions(spark, seed):
    one = example(spark)
    target, context = masked(masks.with_mask_v1(one, "next_action", F.lit(0.2), seed))
    assert (target, context) in [([3], [0, 1, 2]), ([7], [0, 1, 2, 3, 4, 5, 6])]
    target, context = masked(masks.with_mask_v1(one, "next_observation", F.lit(0.2), seed))
    assert (target, context) in [([4, 5], [0, 1, 2, 3]), ([8, 9], [*range(8)])]
    target, context = masked(masks.with_mask_v1(one, "inverse_dynamics", F.lit(0.2), seed))
    assert (target, context) in [([3], [4, 5, 8, 9]), ([7], [8, 9])]
    target, context = masked(masks.with_mask_v1(one, "observation_denoising", F.lit(0.2), seed))
    assert (target, context) in [([4, 5], [0, 1, 3, 6]), ([8, 9], [0, 1, 7])]
    target, context = masked(masks.with_mask_v1(one, "goal_conditioned_action", F.lit(0.2), seed))
    assert (target, context) in [([3], [0, 1, 2, 4, 5, 6, 7]), ([7], [0, 1, 2, 3, 4, 5, 6, 8, 9])]
    target, context = masked(masks.with_mask_v1(one, "full_completion", F.lit(0.6), seed))
    assert len({BIDX[i] for i in context} - {0}) == 2 and sorted(target + context) == [*range(10)]
    target, context = masked(masks.with_mask_v2(one, "inverse_dynamics", F.lit(0.2), seed))
    assert (target, context) in [([3], [0, 1, *range(4, 10)]), ([7], [0, 1, 2, 3, 4, 5, 8, 9])]
    target, _ = masked(masks.with_mask_v2(one, "obs_denoising", F.lit(0.2), seed))
    assert len(target) == 2 and set(target) <= {4, 5, 8, 9}
    target, _ = masked(masks.with_mask_v2(one, "intermediate_imputation", F.lit(0.2), seed))
    assert target[1] == target[0] + 1 and 2 <= target[0] <= 7
    target, _ = masked(masks.with_mask_v2(one, "random_block", F.lit(0.0001), seed))
    assert len(target) == 1 and target[0] >= 2


def test_fallbacks_and_empty_targets(spark):
    goal_only = example(spark, [1, 1, 1], [0, 0, 0], [0, 0, 0])
    assert masked(masks.with_mask_v2(goal_only, "suffix", F.lit(0.2))) == ([], [0, 1, 2])
    assert masked(masks.with_mask_v2(goal_only, "inverse_dynamics", F.lit(0.2))) == ([], [0, 1, 2])
    assert masks.with_mask_v2(goal_only, "next_obs", F.lit(0.2)).collect()[0]["tgt"] is None
    fell = masks.with_mask_v1(goal_only, "next_action", F.lit(0.4)).collect()[0]
    assert fell["fell_back"] and sum(fell["tgt"]) == 1 and [a != b for a, b in zip(fell["ctx"], fell["tgt"])] == [True] * 3
    two_steps = masks.with_mask_v1(example(spark), "intermediate_imputation", F.lit(0.2)).collect()[0]
    assert two_steps["fell_back"]


def test_halves_go_to_the_even(spark):
    target, _ = masked(masks.with_mask_v2(example(spark), "suffix", F.lit(0.3125)))
    assert len(target) == 2


def test_corruption(spark):
    one = masks.with_mask_v2(example(spark), "inverse_dynamics", F.lit(0.2))
    r = batches.corrupted_v2(one).collect()[0]
    hidden = [not c and not t for c, t in zip(r["ctx"], r["tgt"])]
    assert r["scored"] == r["tgt"] and r["labels"] == [10 + i for i in range(10)]
    assert r["inp"] == [1 if s or h else x for s, h, x in zip(r["scored"], hidden, r["labels"])]
    first = batches.corrupted_v1(masks.with_mask_v2(example(spark), "suffix", F.lit(0.8)), F.lit(0.0)).collect()[0]
    assert sum(first["scored"]) == 1  # one is forced, the other targets stay visible
    assert sum(x == 1 for x in first["inp"]) == 1
    wide = batches.padded(batches.corrupted_v2(one), F.lit(13)).collect()[0]
    assert wide["inp"][10:] == [0, 0, 0] and wide["valid"] == [True] * 10 + [False] * 3 and len(wide["scored"]) == 13
    long = batches.padded_to_longest(batches.corrupted_v2(one.withColumn("train_step", F.lit(0)).unionByName(masks.with_mask_v2(example(spark, BTYPE[:4], STEP[:4], BIDX[:4], 2), "suffix", F.lit(0.2)).withColumn("train_step", F.lit(0)))), 8)
    assert [len(x["inp"]) for x in long.collect()] == [8, 8]


def test_losses_by_hand(spark):
    def tokens(t, nll, scored=True):
        return spark.createDataFrame([(0, 0, 0, t, 3, scored, x) for x in nll], "train_step int, micro int, slot int, t double, btype int, scored boolean, nll double")

    loss = lambda df, w: losses.masked_loss(df, ["train_step"], w).collect()[0]["loss"]
    assert loss(tokens(0.5, [2.0, 4.0]), True) == 6.0
    assert loss(tokens(0.005, [2.0, 4.0]), True) == 150.0
    assert loss(tokens(0.5, [2.0], False), True) == 0.0
    slots = [(1, s, o, 4.0) for s, o in enumerate("aaab")] + [(2, s, o, 2.0) for s, o in enumerate("abbb")]
    mean = losses.fractional_loss(spark.createDataFrame(slots, "train_step int, slot int, objective string, loss double"))
    assert {r["objective"]: r["loss"] for r in mean.collect()} == {"a": 3.5, "b": 2.5}
    history = spark.createDataFrame([(i, float(i)) for i in range(1, 17)], "train_step int, loss double")
    assert [(r[0], r[1]) for r in losses.moving_average(history, 15).orderBy("train_step").collect()] == [(15, 8.0), (16, 9.0)]
    assert losses.moving_average(history.filter("train_step <= 10"), 15).count() == 10
    nan = spark.createDataFrame([(1, float("nan")), (2, float("nan"))], "train_step int, loss double")
    assert losses.best(nan, "loss").collect()[0]["best"] is None
    assert losses.last(history, "loss").collect()[0]["last"] == 16.0


def test_schedules(spark):
    p = F.col("p")
    r = spark.createDataFrame([(0.25,)], "p double").select(schedules.gate(p, 0.1, 0.4).alias("g"), schedules.target_ratio(p).alias("r"), schedules.loss_weight(F.lit(0.001)).alias("w"), schedules.mask_rate(F.lit(2.0), 0.1, 0.6).alias("m")).collect()[0]
    assert math.isclose(r["g"], 0.5) and math.isclose(r["r"], 0.225) and r["w"] == 50.0 and math.isclose(r["m"], 1.1)


def test_draws_are_uniform_and_keyed(spark):
    rows = spark.range(20000).select(uniform(0, "x", F.col("id")).alias("u"))
    s = rows.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).collect()[0]
    assert abs(s[0] - 0.5) < 0.01 and abs(s[1] - 12**-0.5) < 0.01 and 0 <= s[2] and s[3] < 1
    assert sorted(r[0] for r in rows.collect()) == sorted(r[0] for r in rows.repartition(7).collect())


def test_sampling(spark):
    plan = sampling.without_replacement(spark, 100, 5, 10).toPandas()
    assert plan.groupby("train_step").row_no.nunique().tolist() == [10] * 5
    every = sampling.without_replacement(spark, 6, 3, 10).toPandas()
    assert every.groupby("train_step").row_no.nunique().tolist() == [6] * 3
    assert sampling.with_replacement(spark, 3, 50, 4).toPandas().row_no.between(0, 2).all()
    index = sampling.dense_index(spark.range(100, 200).withColumnRenamed("id", "k").repartition(7), "k").toPandas().sort_values("k")
    assert index.row_no.tolist() == [*range(100)]


def test_jsonl(spark, tmp_path):
    lines = [
        {"trajectory_id": "a", "blocks": [{"step": 1, "type": "Think", "text": "Hi", "metadata": {"x": "y"}}], "leakage_flags": [{"step": 1}, "free text", {"type": "t"}, {"step": None}, {"step": "7"}]},
        {"trajectory_id": "b", "blocks": [{"type": "Other", "text": "x"}], "leakage_flags": None},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(lines[0]), "", "   ", json.dumps(lines[1])]) + "\n")
    rows = trajectories.read_jsonl(spark, str(tmp_path / "x.jsonl")).withColumn("leaky", trajectories.leaky_steps(F.col("leakage_flags"))).orderBy("trajectory_id").collect()
    assert [r["leaky"] for r in rows] == [["n:1", "null", "s:7"], []]
    (tmp_path / "bad.jsonl").write_text('{"trajectory_id": "a"\n')
    with pytest.raises(Exception):
        trajectories.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_blocks_to_examples(spark):
    block = "array<struct<step:int,type:string,text:string>>"
    rows = [
        (1, "train", [(0, "Goal", "Do it."), (1, "Think", "leaked"), (None, "Action", "go"), (1, "Other", "x"), (2, "Observation", " \n"), (2, "Observation", "Ça va")], ["n:1"]),
        (2, "train", [(None, "Think", "dropped as null matches null")], ["null"]),
        (3, "train", None, []),
        (4, "train", [(1, "Think", None)], []),
    ]
    df = spark.createDataFrame(rows, f"traj_no long, split string, blocks {block}, leaky array<string>")
    out = {r["traj_no"]: [(t["token"], t["btype"], t["step"], t["bidx"]) for t in r["tok"]] for r in examples.all_examples(df).collect()}
    assert out[1] == [("do", 1, 0, 0), ("it", 1, 0, 0), (".", 1, 0, 0), ("go", 3, -1, 1), ("ça", 4, 2, 2), ("va", 4, 2, 2)]
    assert out[2] == out[3] == out[4] == []
    assert len({r["tok"][-1]["token"] for r in examples.truncated(examples.all_examples(df), 2).collect()}) == 1
    assert examples.not_overlong(examples.all_examples(df), 6).count() == 1 and examples.not_overlong(examples.all_examples(df), 5).count() == 0
    counts = examples.dropped(examples.all_examples(df), 5).collect()[0]
    assert (counts["kept"], counts["dropped"]) == (0, 4)


def test_vocabulary_round_trip(spark, tmp_path):
    tokens = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("b a b c a d".split())], "traj_no long, block_no int, pos int, token string")
    vocab = vocabulary.ranked_vocabulary(tokens, 7)
    assert {r["token"]: r["id"] for r in vocab.collect()} == {"b": 4, "a": 5, "c": 6}  # ties by first occurrence
    documents.write_vocabulary(vocab, str(tmp_path / "v"))
    assert {r["token"]: r["id"] for r in documents.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {"b": 4, "a": 5, "c": 6}
    coded = vocabulary.with_ids(example(spark).withColumn("tok", F.transform("tok", lambda t: t.withField("token", F.when(t["pos"] == 0, "a").otherwise("zzz")).dropFields("id"))), vocab).collect()[0]
    assert [t["id"] for t in coded["tok"]] == [5] + [2] * 9


def test_ids_of_a_large_vocabulary_and_repeated_tokens(spark):
    """The join that is used beyond the bound gives the same, extra columns and empty examples included."""
    words = spark.createDataFrame([("w1", 9), ("w1", 7), ("w3", 8), (None, 5), ("unused", 6)], "token string, id int")
    rows = example(spark).withColumn("tok", F.transform("tok", lambda t: t.dropFields("id"))).withColumn("token", F.lit("clash"))
    rows = rows.unionByName(rows.withColumns({"traj_no": F.lit(2).cast("long"), "tok": F.slice("tok", 1, 0), "n": F.lit(0)}))
    one = sorted(map(str, vocabulary.with_ids(rows, words).collect()))
    assert one == sorted(map(str, vocabulary.with_ids(rows.drop("token"), words, most=2).withColumn("token", F.lit("clash")).select(rows.columns).collect()))
    assert [t["id"] for t in vocabulary.with_ids(rows, words).filter("n > 0").first()["tok"]] == [2, 7, 2, 8] + [2] * 6


def test_first_deliveries(spark):
    """By time, a missing time first; ties, many repeats and a table beyond the bound come to one row each."""
    rows = [(1, 5, "a"), (1, 3, "b"), (2, 4, "c"), (2, 4, "c"), (3, None, "d"), (3, 1, "e"), (4, 1, "f"), (None, 1, "g"), (5, None, "h"), (5, None, "h"), (6, 3, "i"), (6, 2, "j"), (6, 9, "k")]
    df = spark.createDataFrame(rows, "traj_no long, loaded_at int, v string").repartition(3)
    for most in (1_000_000, 2):
        got = sorted((r["traj_no"], r["v"]) for r in trajectories.delivered_once(df, most).collect())
        assert got == [(1, "b"), (2, "c"), (3, "d"), (4, "f"), (5, "h"), (6, "j")]
    assert trajectories.delivered_once(df.filter("false")).count() == 0 and trajectories.delivered_once(df.filter("traj_no = 4")).count() == 1


def test_shared_folder(spark):
    from skeinworks import session

    kept = session.stash(spark.range(3), "x")
    assert kept.count() == 3 and session.shared_dir(spark) == session.shared_dir(spark)


def test_documents_and_logs(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"mask_token_id": 7, "hidden": 1, "pad_token_id": 0, "MaskX": "a"}, indent=1))
    doc = documents.read_document(spark, str(tmp_path / "config.json")).select(documents.matching_keys(F.col("document")).alias("m")).collect()[0]["m"]
    assert set(doc) == {"mask_token_id", "pad_token_id", "MaskX"}
    (tmp_path / "a.py").write_text("class Foo:\n  pass\nclass Bar(Foo):\n  pass\n")
    assert [r["name"] for r in documents.class_names(documents.read_texts(spark, str(tmp_path / "*.py"))).collect()] == ["Bar", "Foo"]
    (tmp_path / "run.out").write_text("hello\n[step    0/400] train=1.500 val=2.250 rate=0.20 nextobs=nan\n[step 20/400] train=1.0 val=2.0\n")
    log = documents.read_progress(spark, str(tmp_path / "*.out")).orderBy("step").collect()
    assert (log[0]["steps"], log[0]["loss"], log[0]["val_loss"], log[0]["mask_rate"]) == (400, 1.5, 2.25, 0.2) and math.isnan(log[0]["val_nextobs"])
    assert log[1]["val_nextobs"] is None and len(log) == 2
    documents.write_metrics(spark.createDataFrame([(1.5, {"a": 2})], "loss double, budget map<string,int>"), str(tmp_path / "m"))
    text = "\n".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    assert json.loads(text) == {"loss": 1.5, "budget": {"a": 2}} and "\n" in text.strip()
    lines = documents.progress_lines(spark.createDataFrame([(3, 1.0, 2.0), (4, 1.0, None)], "step int, loss double, val_loss double"), 9).collect()
    assert [r["line"] for r in lines] == ["[step    3/9] train=1.000 val=2.000"]


def test_names(spark):
    dotted = spark.createDataFrame([("m.0.q_proj",), ("m.1.q_proj",), ("m.lm_head",), ("m.gate",), (None,)], "name string")
    assert [r["leaf"] for r in names.leaf_names(dotted, "name", ["proj"], []).collect()] == ["q_proj"]
    assert [r["leaf"] for r in names.leaf_names(dotted, "name", ["none"], ["head", "proj"]).collect()] == ["gate"]
    assert names.leaf_names(dotted.filter("false"), "name", ["proj"], []).count() == 0
    assert spark.range(1).select(names.parsed_list(F.lit(" a, b,,c ")).alias("x")).collect()[0]["x"] == ["a", "b", "c"]

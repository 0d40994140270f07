"""Queries over the operators of the trajectory pipeline; ``reference_sql`` says the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions import schedules
from skeinworks.functions.draws import pick, uniform
from skeinworks.functions.words import split_name
from skeinworks.operators import batches, checks, examples, losses, manifest, masks, names, sampling, vocabulary
from skeinworks.schema import BIDIRECTIONAL_OBJECTIVES, CAUSAL_OBJECTIVES, OBJECTIVES, PAD_ID
from skeinworks.session import shared_dir, stash
from skeinworks.sources import documents
from skeinworks.sources.tables import table
from skeinworks.sources.trajectories import delivered_once, load_trajectories, read_jsonl, shaped

#: Parameters of the queries, the same in the SQL: the length beyond which examples are dropped, that to which the first generation cuts them,
#: a short one to show both policies; the sampled runs have ``STEPS`` steps of ``BATCH`` examples and ``VAL_BATCHES`` batches of validation.
MAX_LEN, V1_LEN, SHORT, RATE, VOCABULARY, STEPS, BATCH, VAL_BATCHES, SEED = 8192, 1024, 256, 0.2, 16_000, 24, 4, 3, 0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def whole(df: DataFrame) -> DataFrame:
    """Integers as bigint, the type that SQL sums and counts have."""
    kinds = {f.name: F.col(f.name).cast("long") for f in df.schema if isinstance(f.dataType, T.IntegerType)}
    return df.withColumns(kinds) if kinds else df


def every(spark: SparkSession, d: str) -> DataFrame:
    return examples.all_examples(load_trajectories(spark, d))


def fitting(spark: SparkSession, d: str) -> DataFrame:
    return examples.not_overlong(every(spark, d), MAX_LEN)


def cut_v1(spark: SparkSession, d: str) -> DataFrame:
    return examples.truncated(every(spark, d), V1_LEN)


def train(spark: SparkSession, d: str) -> DataFrame:
    return load_trajectories(spark, d).filter("split = 'train'")


# Text and examples.


@query
def tokenize(spark, d):
    blocks = load_trajectories(spark, d).select("traj_no", F.posexplode("blocks").alias("block_no", "b")).filter("b.text IS NOT NULL")
    words = examples.word_tokens(F.col("b.text"))
    return whole(blocks.select("traj_no", "block_no", F.size(words).alias("tokens"), F.md5(F.array_join(words, " ")).alias("digest")))


@query
def block_counts(spark, d):
    return whole(manifest.block_totals(load_trajectories(spark, d)))


@query
def leak_set(spark, d):
    return load_trajectories(spark, d).select("traj_no", F.explode("leaky").alias("step_key")).distinct()


@query
def drop_leaky_think(spark, d):
    rows = load_trajectories(spark, d).select("traj_no", "leaky", F.posexplode("blocks").alias("block_no", "b"))
    return whole(rows.filter(examples.is_leaky(F.col("b"), F.col("leaky"))).select("traj_no", "block_no"))


@query
def flatten_tokens(spark, d):
    return whole(examples.token_rows(every(spark, d)))


@query
def dense_bidx(spark, d):
    return whole(examples.token_rows(every(spark, d)).groupBy("traj_no", "bidx", "btype", "step").agg(F.count("*").alias("tokens")))


@query
def truncate_prefix(spark, d):
    rows = examples.truncated(every(spark, d), SHORT)
    last = F.element_at("tok", -1)
    return whole(rows.select("traj_no", "n", last["token"].alias("last_token"), last["bidx"].alias("last_bidx"), last["step"].alias("last_step")))


@query
def drop_overlong(spark, d):
    return whole(examples.not_overlong(every(spark, d), SHORT).select("traj_no", "split", "n"))


@query
def dropped_count(spark, d):
    return examples.dropped(every(spark, d), SHORT)


# Vocabulary.


@query
def token_freq(spark, d):
    return vocabulary.token_frequency(vocabulary.corpus_tokens(train(spark, d))).select("token", "n")


def train_vocabulary(spark, d):
    return vocabulary.ranked_vocabulary(vocabulary.corpus_tokens(train(spark, d)), VOCABULARY)


@query
def vocab_topk(spark, d):
    return whole(train_vocabulary(spark, d))


@query
def encode_unk(spark, d):
    rows = vocabulary.with_ids(every(spark, d), train_vocabulary(spark, d))
    return whole(examples.token_rows(rows).select("traj_no", "pos", "id"))


@query
def encode_given_vocab(spark, d):
    rows = vocabulary.with_ids(every(spark, d), table(spark, d, "vocab"))
    return whole(examples.token_rows(rows).groupBy("traj_no").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("id") == 2, 1)).alias("unknown"), F.sum(F.col("id") * (F.col("pos") + 1)).alias("checksum")))


# Steps and positions.


@query
def steps_present(spark, d):
    rows = every(spark, d).filter("n > 0").select("traj_no", masks.steps_present().alias("s"))
    return whole(rows.select("traj_no", F.size("s").alias("steps"), F.array_join("s", ",").alias("list")))


@query
def action_blocks(spark, d):
    ids = masks.sorted_distinct("bidx", lambda t: t["btype"] == 3)
    inner = masks.sorted_distinct("bidx", lambda t: t["bidx"] != 0)
    return whole(every(spark, d).filter("n > 0").select("traj_no", F.size(inner).alias("interior"), F.array_join(ids, ",").alias("actions")))


@query
def first_index(spark, d):
    rows = examples.token_rows(every(spark, d)).filter("step >= 1")
    return whole(rows.groupBy("traj_no", "step", "btype").agg(F.min("pos").alias("first_pos")))


@query
def last_obs_step(spark, d):
    last = F.array_max(masks.sorted_distinct("step", lambda t: (t["btype"] == 4) & (t["step"] >= 1)))
    return whole(every(spark, d).filter("n > 0").select("traj_no", F.coalesce(last, F.lit(-1)).alias("step")))


# Masks.


def _v1(objective: str) -> Query:
    def run(spark, d):
        rows = masks.with_mask_v1(cut_v1(spark, d), objective, F.lit(RATE), SEED)
        return masks.mask_summary(rows, "fell_back")

    return run


def _v2(objective: str) -> Query:
    return lambda spark, d: masks.mask_summary(masks.with_mask_v2(fitting(spark, d), objective, F.lit(RATE), SEED).filter("tgt IS NOT NULL"))


for _name in OBJECTIVES:
    QUERIES[f"{_name}_v1"] = _v1(_name)
for _name in ["random_block", "suffix", *BIDIRECTIONAL_OBJECTIVES, "next_obs", *CAUSAL_OBJECTIVES]:
    QUERIES[f"{_name}_v2"] = _v2(_name)


@query
def dispatch_d_flex(spark, d):
    return masks.mask_summary(masks.with_drawn_mask_v2(fitting(spark, d), "d_flex", F.lit(RATE), SEED), "objective")


@query
def dispatch_causal(spark, d):
    return masks.mask_summary(masks.with_drawn_mask_v2(fitting(spark, d), "causal", F.lit(RATE), SEED), "objective")


def suffix_tokens(spark, d) -> DataFrame:
    """The suffix mask over all fitting examples, as token rows with ``scored``."""
    rows = masks.with_mask_v2(fitting(spark, d), "suffix", F.lit(RATE), SEED)
    return rows.select("traj_no", F.inline(F.zip_with("tok", "tgt", lambda t, b: F.struct(t["pos"].alias("pos"), t["btype"].alias("btype"), b.alias("scored")))))


@query
def budget_suffix_v2(spark, d):
    """Scored tokens by type of block, the rate over all, and how many examples there are."""
    rows = masks.with_mask_v2(fitting(spark, d), "suffix", F.lit(RATE), SEED)
    pairs = F.arrays_zip("tok", "tgt")

    def scored_of(code: int) -> Column:
        return F.size(F.filter(pairs, lambda x: x["tgt"] & (x["tok"]["btype"] == code))).cast("long")

    eligible = F.size(F.filter("tok", lambda t: t["btype"] != 1)).cast("long")
    per = rows.select(*[scored_of(code).alias(name) for code, name in losses.CODE_NAMES.items()], eligible.alias("eligible"))
    sums = per.agg(*[F.sum(c).alias(c) for c in per.columns], F.count("*").alias("trajectories"))
    scored = F.col("goal") + F.col("think") + F.col("action") + F.col("obs")
    return sums.select("goal", "think", "action", "obs", F.round(scored / F.greatest("eligible", F.lit(1)), 6).alias("rate"), "trajectories")


@query
def achieved_rate(spark, d):
    rates = losses.achieved_rate(suffix_tokens(spark, d), "traj_no")
    return rates.select("traj_no", F.round("rate", 6).alias("rate"))


# Plans and schedules.


def numbered(spark, d, split: str) -> tuple[DataFrame, int]:
    """The ``traj_no`` of the fitting examples of a split, written once, and how many: a plan of steps refers to them by number."""
    rows = examples.lengths(load_trajectories(spark, d).filter(F.col("split") == split))
    rows = stash(examples.not_overlong(rows, MAX_LEN).select("traj_no"), "numbers")
    return rows, rows.count()


def drawn_examples(plan: DataFrame, numbers: DataFrame, d: str, vocab: DataFrame | None = None, cut: int | None = None) -> DataFrame:
    """The examples of a plan; only those that it draws are flattened, cut and encoded, each once. A plan has as many rows as its steps have slots."""
    spark = plan.sparkSession
    picked = stash(sampling.sampled(plan, numbers), "plan")
    rows = examples.all_examples(load_trajectories(spark, d).join(F.broadcast(picked.select("traj_no").distinct()), "traj_no", "left_semi"))
    rows = examples.truncated(rows, cut) if cut else rows
    return picked.join(vocabulary.with_ids(rows, vocab) if vocab is not None else rows, "traj_no")


@query
def sample_with_replacement(spark, d):
    rows, n = numbered(spark, d, "train")
    plan = sampling.with_replacement(spark, n, STEPS, BATCH, SEED)
    return whole(sampling.sampled(plan, rows).select("train_step", "slot", "traj_no"))


@query
def sample_without_replacement(spark, d):
    rows, n = numbered(spark, d, "train")
    plan = sampling.without_replacement(spark, n, STEPS, BATCH, SEED)
    return whole(sampling.sampled(plan, rows).select("train_step", "slot", "traj_no"))


def steps_of(spark, steps: int = 1000) -> DataFrame:
    return spark.range(steps).select(F.col("id").alias("train_step")).withColumn("p", schedules.progress(F.col("train_step"), steps))


@query
def objective_schedule(spark, d):
    drawn = schedules.drawn_objective(F.col("p"), uniform(SEED, "objective", F.col("train_step")))
    ordinal = losses.objective_ordinal(F.col("objective"), OBJECTIVES)
    return steps_of(spark).select("train_step", drawn.alias("objective")).withColumn("ordinal", ordinal)


@query
def objective_weights(spark, d):
    weights = schedules.objective_weights(F.col("p"))
    return steps_of(spark).select("train_step", *[F.round(w, 6).alias(name) for name, w in weights.items()])


@query
def curriculum(spark, d):
    return steps_of(spark).select("train_step", F.round(schedules.target_ratio(F.col("p")), 6).alias("ratio"), F.round(schedules.mask_rate(F.col("p"), 0.1, 0.6), 6).alias("rate"), schedules.mask_rate(F.col("p"), RATE).alias("constant"))


@query
def noise_weights(spark, d):
    t = schedules.noise_level(uniform(SEED, "t", F.col("train_step")))
    return steps_of(spark).select("train_step", F.round(t, 6).alias("t"), F.round(schedules.loss_weight(t), 6).alias("weight"))


# Corruption and batches.


def coded(spark, d, cut: bool = False) -> DataFrame:
    return vocabulary.with_ids(cut_v1(spark, d) if cut else fitting(spark, d), table(spark, d, "vocab"))


def positions(rows: DataFrame, *keep: str) -> DataFrame:
    """What a batch holds, per example: sums over aligned arrays."""

    def total(array: str, when: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(F.transform(array, when), F.lit(0).cast("long"), lambda a, x: a + x)

    def flag(array: str) -> Column:
        return total(array, lambda x, i: F.when(x, i.cast("long") + 1).otherwise(F.lit(0).cast("long")))

    def value(array: str) -> Column:
        return total(array, lambda x, i: x.cast("long") * (i.cast("long") + 1))

    return rows.select(
        *keep,
        F.size("inp").cast("long").alias("width"),
        value("inp").alias("inp"),
        value("labels").alias("labels"),
        value("btypes").alias("btypes"),
        flag("valid").alias("valid"),
        flag("scored").alias("scored"),
    )


def corrupted_batches_v1(spark, d) -> DataFrame:
    """One objective per step, rows with replacement, a noise level per row."""
    rows, n = numbered(spark, d, "train")
    plan = sampling.with_replacement(spark, n, STEPS, BATCH, SEED)
    p = schedules.progress(F.col("train_step"), STEPS)
    drawn = drawn_examples(plan, rows, d, table(spark, d, "vocab"), V1_LEN)
    drawn = drawn.withColumn("objective", schedules.drawn_objective(p, uniform(SEED, "objective", F.col("train_step"))))
    salt = F.concat_ws(".", "train_step", "slot")
    masked = masks.with_masks(drawn, masks.by_objective(OBJECTIVES, lambda name: masks.masks_v1(name, schedules.target_ratio(p), SEED, salt)["m"]))
    t = schedules.noise_level(uniform(SEED, "t", F.col("train_step"), F.col("slot")))
    return batches.corrupted_v1(masked.withColumn("t", t), F.col("t"), SEED, salt=salt)


def corrupted_batches_v2(spark, d, objective_set: str = "d_flex") -> DataFrame:
    """Different rows per step, an objective per row, a rate that changes with progress."""
    rows, n = numbered(spark, d, "train")
    plan = sampling.without_replacement(spark, n, STEPS, BATCH, SEED)
    rate = schedules.mask_rate(schedules.progress(F.col("train_step"), STEPS), 0.1, 0.6)
    drawn = drawn_examples(plan, rows, d, table(spark, d, "vocab")).withColumn("rate", rate)
    return batches.corrupted_v2(masks.with_drawn_mask_v2(drawn, objective_set, F.col("rate"), SEED, F.col("train_step")))


@query
def corrupt_v1(spark, d):
    masked = masks.with_mask_v1(coded(spark, d, True), "next_observation", F.lit(RATE), SEED)
    return positions(batches.corrupted_v1(masked, F.lit(0.3), SEED), "traj_no")


@query
def corrupt_v2(spark, d):
    masked = masks.with_mask_v2(coded(spark, d), "inverse_dynamics", F.lit(RATE), SEED)
    return positions(batches.corrupted_v2(masked), "traj_no")


@query
def pad_static(spark, d):
    masked = masks.with_mask_v2(coded(spark, d, True), "suffix", F.lit(RATE), SEED)
    return positions(batches.padded(batches.corrupted_v2(masked), F.lit(V1_LEN), PAD_ID), "traj_no")


@query
def batch_v1(spark, d):
    rows = batches.padded(corrupted_batches_v1(spark, d), F.lit(V1_LEN))
    return whole(positions(rows.withColumn("t", F.round("t", 6)), "train_step", "slot", "traj_no", "objective", "t"))


@query
def pad_dynamic(spark, d):
    rows = batches.padded_to_longest(corrupted_batches_v2(spark, d), MAX_LEN)
    return whole(positions(rows, "train_step", "slot", "traj_no", "objective"))


def next_observations(spark, d, steps: int) -> DataFrame:
    """Per step up to ``BATCH`` validation examples that have a last observation, from three times as many drawn; ``place`` counts them."""
    numbers, n = numbered(spark, d, "validation")
    plan = sampling.without_replacement(spark, n, steps, 3 * BATCH, SEED)
    masked = masks.with_mask_v2(drawn_examples(plan, numbers, d, table(spark, d, "vocab")), "next_obs", F.lit(RATE), SEED).filter("tgt IS NOT NULL")
    order = sampling.Window.partitionBy("train_step").orderBy("slot")
    return masked.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < BATCH)


@query
def nextobs_batch(spark, d):
    """The shared batch of the next observation."""
    return whole(positions(batches.padded_to_longest(batches.corrupted_v2(next_observations(spark, d, 1)), MAX_LEN), "place", "traj_no"))


@query
def batch_objectives(spark, d):
    """Per step: examples, different ones, their objectives, the rate aimed at and the one reached."""
    rows = corrupted_batches_v2(spark, d)
    eligible = F.size(F.filter("btypes", lambda b: b != 1))
    scored = F.size(F.filter("scored", lambda b: b))
    steps = rows.groupBy("train_step").agg(
        F.count("*").alias("examples"),
        F.count_distinct("traj_no").alias("different"),
        F.array_join(F.array_sort(F.collect_set("objective")), ",").alias("objectives"),
        F.round(F.first("rate"), 6).alias("target"),
        F.round(F.sum(scored) / F.greatest(F.sum(eligible), F.lit(1)), 6).alias("achieved"),
    )
    return whole(steps)


@query
def examples_subword(spark, d):
    """Examples over another tokenizer than words: bytes, by blocks and tokens of every trajectory."""
    rows = examples.all_examples(load_trajectories(spark, d), tokenizer=examples.byte_tokens).filter("n > 0")
    digest = F.md5(F.array_join(F.transform("tok", lambda t: t["token"]), ""))
    return whole(rows.select("traj_no", "n", (F.element_at("tok", -1)["bidx"] + 1).alias("blocks"), digest.alias("digest")))


@query
def masked_preview(spark, d):
    masked = masks.with_mask_v2(coded(spark, d), "suffix", F.lit(RATE), SEED)
    return batches.preview(batches.corrupted_v2(masked))


# Losses, over per-token values that stand in for a model's.


def token_losses(spark, d) -> DataFrame:
    """Token rows of ``STEPS`` batches under the suffix mask; ``nll`` is a keyed draw."""
    rows, n = numbered(spark, d, "train")
    plan = sampling.with_replacement(spark, n, STEPS, BATCH, SEED)
    masked = masks.with_mask_v2(drawn_examples(plan, rows, d), "suffix", F.lit(RATE), SEED)
    objective = pick(F.array(*map(F.lit, BIDIRECTIONAL_OBJECTIVES)), uniform(SEED, "slot.objective", F.col("train_step"), F.col("slot")))
    t = schedules.noise_level(uniform(SEED, "t", F.col("train_step"), F.col("slot")))
    token = F.zip_with("tok", "tgt", lambda x, b: F.struct(x["pos"].alias("pos"), x["btype"].alias("btype"), b.alias("scored")))
    flat = masked.select("train_step", "slot", F.floor(F.col("slot") / 2).cast("int").alias("micro"), objective.alias("objective"), t.alias("t"), F.inline(token))
    nll = F.lit(6.0) * uniform(SEED, "nll", F.col("train_step"), F.col("slot"), F.col("pos"))
    return flat.withColumn("nll", nll)


def step_losses(spark, d) -> DataFrame:
    return losses.masked_loss(token_losses(spark, d), ["train_step"], False)


@query
def masked_loss_weighted(spark, d):
    return whole(losses.masked_loss(token_losses(spark, d), ["train_step"], True).select("train_step", F.round("loss", 6).alias("loss")))


@query
def masked_loss_plain(spark, d):
    return whole(step_losses(spark, d).select("train_step", F.round("loss", 6).alias("loss")))


@query
def accum_mean(spark, d):
    return whole(losses.accumulated_loss(token_losses(spark, d), 2).select("train_step", F.round("loss", 6).alias("loss")))


def mean_of_batches(tokens: DataFrame) -> DataFrame:
    """The mean over batches of the plain loss, as one number; not a number where there is no batch."""
    steps = losses.masked_loss(tokens, ["train_step"], False)
    return steps.agg(F.round(F.coalesce(F.avg("loss"), F.lit(float("nan"))), 6).alias("val_loss"))


def scored_tokens(masked: DataFrame) -> DataFrame:
    """Token rows of masked examples with a keyed ``nll``."""
    flat = masked.select("train_step", "traj_no", F.inline(F.zip_with("tok", "tgt", lambda x, b: F.struct(x["pos"].alias("pos"), b.alias("scored")))))
    return flat.withColumn("nll", F.lit(6.0) * uniform(SEED, "val.nll", F.col("train_step"), F.col("traj_no"), F.col("pos")))


@query
def validation_mean(spark, d):
    """The loss on ``VAL_BATCHES`` batches of the validation split, each example under an objective of its own."""
    numbers, n = numbered(spark, d, "validation")
    plan = sampling.without_replacement(spark, n, VAL_BATCHES, BATCH, SEED)
    return mean_of_batches(scored_tokens(masks.with_drawn_mask_v2(drawn_examples(plan, numbers, d), "d_flex", F.lit(RATE), SEED, F.col("train_step"))))


@query
def validation_nextobs(spark, d):
    """The loss on the last observations of ``VAL_BATCHES`` batches of the validation split; batches without any do not count."""
    return mean_of_batches(scored_tokens(next_observations(spark, d, VAL_BATCHES)))


@query
def supervision_budget(spark, d):
    return losses.supervision_budget(token_losses(spark, d))


@query
def obj_mean(spark, d):
    named = step_losses(spark, d).withColumn("objective", schedules.drawn_objective(schedules.progress(F.col("train_step"), STEPS), uniform(SEED, "objective", F.col("train_step"))))
    return losses.loss_by_objective(named).select("objective", F.round("loss", 6).alias("loss"))


@query
def obj_fractional_mean(spark, d):
    rows = stash(token_losses(spark, d), "token-losses")
    slots = rows.select("train_step", "slot", "objective").distinct().join(losses.masked_loss(rows, ["train_step"], False), "train_step")
    return losses.fractional_loss(slots).select("objective", F.round("loss", 6).alias("loss"))


@query
def mean_rate_macro(spark, d):
    return losses.mean_rate(losses.achieved_rate(token_losses(spark, d), "train_step")).select(F.round("mean_rate", 6).alias("mean_rate"))


def history(spark, steps: int = 400) -> DataFrame:
    """A history of ``steps`` keyed losses, every tenth of which is no number."""
    u = uniform(SEED, "history", F.col("train_step"))
    return spark.range(steps).select(F.col("id").alias("train_step")).withColumn("loss", F.when(F.col("train_step") % 10 == 9, F.lit(float("nan"))).otherwise(F.lit(10.0) * u))


@query
def best_non_nan(spark, d):
    return losses.best(history(spark), "loss").select(F.round("best", 6).alias("best"))


@query
def last_value(spark, d):
    return losses.last(history(spark).filter(~F.isnan("loss")), "loss").select(F.round("last", 6).alias("last"))


def _smooth(k: int, steps: int = 400) -> Query:
    def run(spark, d):
        rows = history(spark, steps).withColumn("loss", F.when(F.isnan("loss"), F.lit(0.0)).otherwise(F.col("loss")))
        return losses.moving_average(rows, k).select("train_step", F.round("smooth", 6).alias("smooth"))

    return run


QUERIES["smooth_k15"] = _smooth(15)
QUERIES["smooth_k25"] = _smooth(25)
QUERIES["smooth_short"] = _smooth(25, 20)


# Checks, manifest, names.


@query
def quality_checks(spark, d):
    rows = batches.padded_to_longest(corrupted_batches_v2(spark, d), MAX_LEN)
    return checks.batch_checks(rows)


@query
def quality_checks_all(spark, d):
    """The same over every fitting example, in batches of neighbours by number."""
    place = sampling.dense_index(examples.not_overlong(examples.lengths(load_trajectories(spark, d)), MAX_LEN), "traj_no")
    step = place.select("traj_no", F.floor(F.col("row_no") / BATCH).alias("train_step"))
    masked = masks.with_drawn_mask_v2(coded(spark, d), "d_flex", F.lit(RATE), SEED)
    return checks.batch_checks(batches.padded_to_longest(batches.corrupted_v2(masked).join(step, "traj_no"), MAX_LEN))


@query
def inverse_dynamics_check(spark, d):
    masked = masks.with_mask_v2(fitting(spark, d), "inverse_dynamics", F.lit(RATE), SEED)
    return checks.inverse_dynamics_checks(masked).agg(F.count("*").alias("examples"), F.count(F.when(F.col("thoughts_hidden"), 1)).alias("thoughts_hidden"), F.count(F.when(F.col("later_seen"), 1)).alias("later_seen"))


@query
def next_obs_check(spark, d):
    return checks.next_obs_checks(masks.with_mask_v2(fitting(spark, d), "next_obs", F.lit(RATE), SEED))


@query
def manifest_splits(spark, d):
    return manifest.split_totals(load_trajectories(spark, d))


def flag_rows(spark, d) -> DataFrame:
    return delivered_once(table(spark, d, "trajectories").select("traj_no", "loaded_at", "leakage_flags"))


@query
def manifest_flags(spark, d):
    return manifest.flag_totals(flag_rows(spark, d))


@query
def manifest_flagged(spark, d):
    return manifest.flagged_totals(flag_rows(spark, d))


@query
def manifest_document(spark, d):
    one = manifest.manifest(load_trajectories(spark, d), flag_rows(spark, d))
    return one.select(F.to_json(F.struct(*one.columns)).alias("manifest"))


@query
def splits_loaded(spark, d):
    """Per canonical split, how many spellings and rows it has."""
    rows = delivered_once(table(spark, d, "trajectories").select("traj_no", "loaded_at", "split"))
    return rows.groupBy(split_name(F.col("split")).alias("name")).agg(F.count_distinct("split").alias("spellings"), F.count("*").alias("rows"))


@query
def name_extract(spark, d):
    """Distinct ``node-`` names in the documents."""
    return documents.class_names(table(spark, d, "documents"), r"node-([a-z]+)")


@query
def leaf_segments(spark, d):
    """The last segments of trajectory ids as dotted names, by the words they hold."""
    dotted = table(spark, d, "trajectories").select(F.regexp_replace("trajectory_id", r"[-/:_]", ".").alias("name"))
    return names.leaf_names(dotted, "name", ["attempt", "run"], ["try"])


# Sources and sinks: what is written to the shared folder is read back.


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def jsonl_examples(spark, d):
    """The examples of a JSONL dump of the trajectories."""
    once = delivered_once(table(spark, d, "trajectories"))
    line = F.struct(F.col("traj_no").cast("string").alias("trajectory_id"), "env", "split", "goal", "blocks", F.try_parse_json("leakage_flags").alias("leakage_flags"))
    path = place(spark, "jsonl")
    once.select(F.to_json(line).alias("value")).write.text(path)
    rows = shaped(read_jsonl(spark, path).withColumn("traj_no", F.col("trajectory_id").cast("long")))
    return whole(examples.lengths(rows))


@query
def vocabulary_round_trip(spark, d):
    path = place(spark, "vocabulary")
    documents.write_vocabulary(train_vocabulary(spark, d), path)
    return whole(documents.read_vocabulary(spark, path))


@query
def document_keys(spark, d):
    """The entries of a JSON document whose key speaks of masks or token ids."""
    path = place(spark, "config")
    one = table(spark, d, "vocab").agg(F.count("*").alias("vocab_size"), (F.max("id") + 1).alias("mask_token_id"), F.lit(0).alias("pad_token_id"), F.min("id").alias("MaskFrom"))
    one.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    found = documents.read_document(spark, path).select(F.explode(documents.matching_keys(F.col("document"))).alias("key", "value"))
    return found


@query
def class_list(spark, d):
    """The names of classes in source files."""
    path = place(spark, "sources")
    table(spark, d, "vocab").select(F.concat(F.lit("class "), "token", F.lit(":")).alias("value")).write.text(path)
    return documents.class_names(documents.read_texts(spark, f"{path}/*"))


@query
def metrics_document(spark, d):
    path = place(spark, "metrics")
    totals = load_trajectories(spark, d).agg(F.count("*").alias("trajectories"), F.sum(F.coalesce(F.size("blocks"), F.lit(0))).alias("blocks"))
    documents.write_metrics(totals.select("trajectories", F.greatest("blocks", F.lit(0)).alias("blocks")), path)
    return documents.read_document(spark, path).select(F.explode("document").alias("key", "value"))


@query
def progress_log(spark, d):
    """Lines of progress of every twentieth step, written and read back."""
    path = place(spark, "log")
    rows = history(spark).filter("train_step % 20 = 0").select(F.col("train_step").alias("step"), "loss", (F.col("loss") / 2).alias("val_loss"))
    documents.progress_lines(rows, 400).select(F.col("line").alias("value")).write.text(path)
    return whole(documents.read_progress(spark, path).select("step", "steps", "loss", "val_loss"))


@query
def parsed_lists(spark, d):
    """How many entries the comma-separated list has that a document is."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL")
    return whole(rows.select("doc_id", F.size(names.parsed_list(F.col("text"))).alias("entries")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from skeinworks.plans.reference_sql import ORACLES

    return dict(ORACLES)

"""Context and target masks of examples under every objective.

``with_mask`` adds ``ctx`` and ``tgt``, arrays of booleans aligned with
``tok``; what is in neither is hidden. All of it is local to a row: predicates
over (pos, step, btype, bidx), with what a row needs once bound before.
Operators of the first generation end in ``_v1``, of the second in ``_v2``;
those that share a name differ. Draws are keyed by ``traj_no``, so a mask does
not depend on partitions; ``salt`` (a column, such as the training step) makes
several masks of one trajectory differ.

``n`` is the number of tokens and must not be 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.draws import between, computed, let, pick, subset, uniform
from skeinworks.schema import ACTION, BIDIRECTIONAL_OBJECTIVES, CAUSAL_OBJECTIVES, GOAL, OBJECTIVES, OBS

Params = Column
Stage = Callable[[Params], dict[str, Column]]
Predicate = Callable[[Column, Params], Column]


def bound(stages: list[Stage], body: Callable[[Params], Column]) -> Column:
    """``body`` of a struct of what the stages name, each stage seeing the names before it; every value is computed once per row."""

    def go(at: int, params: Params, names: list[str]) -> Column:
        if at == len(stages):
            return body(params)
        more = stages[at](params)
        fields = [params[n].alias(n) for n in names] + [c.alias(n) for n, c in more.items()]
        return let(F.struct(*fields), lambda p: go(at + 1, p, [*names, *more]))

    return go(0, F.lit(None), [])


def mask(where: Callable[[Column], Column]) -> Column:
    return F.transform("tok", lambda t: F.coalesce(where(t), F.lit(False)))


def sorted_distinct(field: str, where: Callable[[Column], Column]) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter("tok", where), lambda t: t[field])))


def steps_present() -> Column:
    return sorted_distinct("step", lambda t: t["step"] >= 1)


def steps_of(btype: int) -> Column:
    return sorted_distinct("step", lambda t: (t["step"] >= 1) & (t["btype"] == btype))


def first_token(where: Callable[[Column], Column]) -> Column:
    """The first token that satisfies ``where``; null where there is none."""
    return F.get(F.filter("tok", where), F.lit(0))


def rounded(x: Column) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.rint(x).cast("int")


def keyed(seed: int, purpose: str, salt: Column | None, *more: Column) -> Column:
    return uniform(seed, purpose, F.col("traj_no"), *([salt] if salt is not None else []), *more)


def clipped_count(rate: Column, of: Column, most: Column) -> Column:
    """``rate`` of ``of``, at least 1 and at most ``most``."""
    return F.greatest(F.lit(1), F.least(rounded(rate * of), most))


def masks_of(target: Column, context: Column | None = None) -> Column:
    """The struct of both masks; without a context, all that is not the target."""
    return let(target, lambda t: F.struct((F.transform(t, lambda b: ~b) if context is None else context).alias("ctx"), t.alias("tgt")))


# Fallbacks.


def span_masks(ratio: Column, u: Column) -> Column:
    """A random span of ``ratio`` of all tokens; it may hold the goal."""

    def size(p: Params) -> dict[str, Column]:
        return {"m": F.greatest(F.lit(1), (ratio * F.col("n")).cast("int"))}

    def start(p: Params) -> dict[str, Column]:
        return {"a": between(u, F.lit(0), F.greatest(F.lit(0), F.col("n") - p["m"]))}

    return bound([size, start], lambda p: masks_of(mask(lambda t: (t["pos"] >= p["a"]) & (t["pos"] < p["a"] + p["m"]))))


def block_masks(rate: Column, draw: Callable[[Column], Column]) -> Column:
    """Every token but those of the goal with probability ``rate``; the one with the least draw where none was drawn."""
    # One draw per token, null for those of the goal.
    def draws(p: Params) -> dict[str, Column]:
        return {"u": F.transform("tok", lambda t: F.when(t["btype"] != GOAL, draw(t["pos"])))}

    def least(p: Params) -> dict[str, Column]:
        drawn = F.filter(F.zip_with("tok", p["u"], lambda t, u: F.struct(u.alias("u"), t["pos"].alias("pos"))), lambda d: d["u"].isNotNull())
        return {"least": F.array_min(drawn)}

    def body(p: Params) -> Column:
        hit = lambda t, u: F.coalesce((u < rate) | ((p["least"]["u"] >= rate) & (t["pos"] == p["least"]["pos"])), F.lit(False)) & u.isNotNull()
        return masks_of(F.zip_with("tok", p["u"], hit))

    return bound([draws, least], body)


# The first generation.


def _prepared_v1(objective: str, ratio: Column, u: Callable[..., Column]) -> tuple[list[Stage], Predicate, Predicate]:
    """What the objective needs, its context and its target."""
    if objective in ("next_action", "next_observation", "inverse_dynamics", "observation_denoising"):
        kind = ACTION if objective in ("next_action", "inverse_dynamics") else OBS
        target: Predicate = lambda t, p: (t["step"] == p["t"]) & (t["btype"] == kind)
        step: Stage = lambda p: {"t": let(steps_of(kind), lambda s: pick(s, u("t")))}
        if objective == "inverse_dynamics":
            around: Predicate = lambda t, p: (t["btype"] == OBS) & ((t["step"] == p["t"]) | (t["step"] == p["t"] + 1))
            seen: Stage = lambda p: {"seen": F.exists("tok", lambda t: F.coalesce(around(t, p), F.lit(False)))}
            return [step, seen], lambda t, p: F.when(p["seen"], around(t, p)).otherwise((t["step"] == p["t"]) & (t["btype"] != ACTION)), target
        first: Stage = lambda p: {"first": first_token(lambda t: target(t, p))}
        if objective == "observation_denoising":
            return [step, first], lambda t, p: (t["btype"] == GOAL) | (F.abs(t["bidx"] - p["first"]["bidx"]) == 1), target
        return [step, first], lambda t, p: t["pos"] < p["first"]["pos"], target
    steps: Stage = lambda p: {"steps": steps_present()}
    if objective == "future_from_past":
        early: Stage = lambda p: {"t": pick(F.when(F.size(p["steps"]) > 1, F.slice(p["steps"], F.lit(1), F.size(p["steps"]) - 1)).otherwise(p["steps"]), u("t"))}
        past: Predicate = lambda t, p: (t["step"] <= p["t"]) | (t["btype"] == GOAL)
        return [steps, early], past, lambda t, p: ~past(t, p)
    if objective == "retrodiction":
        late: Stage = lambda p: {"t": pick(F.when(F.size(p["steps"]) > 1, F.slice(p["steps"], F.lit(2), F.size(p["steps"]))).otherwise(p["steps"]), u("t"))}
        return [steps, late], lambda t, p: t["step"] >= p["t"], lambda t, p: (t["step"] >= 1) & (t["step"] < p["t"])
    if objective == "intermediate_imputation":
        two: Stage = lambda p: {"two": F.when(F.size(p["steps"]) >= 3, subset(p["steps"], F.lit(2), lambda s: u("pair", s)))}
        ends: Stage = lambda p: {"a": F.array_min(p["two"]), "z": F.array_max(p["two"])}
        outside: Predicate = lambda t, p: (t["step"] <= p["a"]) | (t["step"] >= p["z"]) | (t["btype"] == GOAL)
        return [steps, two, ends], outside, lambda t, p: ~outside(t, p)
    if objective == "full_completion":
        inner: Stage = lambda p: {"inner": sorted_distinct("bidx", lambda t: t["bidx"] != 0)}
        keep: Stage = lambda p: {"k": F.greatest(F.lit(0), rounded((F.lit(1.0) - ratio) * F.size(p["inner"])))}
        kept: Stage = lambda p: {"kept": F.when(F.size(p["steps"]) > 0, subset(p["inner"], p["k"], lambda b: u("keep", b)))}
        there: Predicate = lambda t, p: F.when(p["kept"].isNotNull(), (t["btype"] == GOAL) | (t["bidx"] == 0) | F.array_contains(p["kept"], t["bidx"]))
        return [steps, inner, keep, kept], there, lambda t, p: ~there(t, p)
    if objective == "goal_conditioned_action":
        acts: Stage = lambda p: {"acts": F.when(F.size(p["steps"]) > 0, sorted_distinct("bidx", lambda t: t["btype"] == ACTION)).otherwise(F.array().cast("array<int>"))}
        some: Stage = lambda p: {"chosen": subset(p["acts"], F.greatest(F.lit(1), rounded(ratio * F.size(p["acts"]))), lambda b: u("act", b))}
        chosen: Predicate = lambda t, p: F.array_contains(p["chosen"], t["bidx"])
        since: Stage = lambda p: {"since": F.array_min(F.transform(F.filter("tok", lambda t: chosen(t, p)), lambda t: t["step"]))}
        return [steps, acts, some, since], lambda t, p: ~((t["btype"] == OBS) & (t["step"] > p["since"])), chosen
    return [], lambda t, p: F.lit(False), lambda t, p: F.lit(False)


def masks_v1(objective: str, ratio: Column, seed: int = 0, salt: Column | None = None, fallback: str = "span") -> Column:
    """``m`` (both masks) and ``fell_back`` of one of the nine objectives of the first generation.

    Where it has no target, ``fallback``: a span, or random tokens as in the second generation.
    """
    stages, context, target = _prepared_v1(objective, ratio, lambda purpose, *more: keyed(seed, f"{objective}.{purpose}", salt, *more))
    own = bound(stages, lambda p: F.struct(mask(lambda t: context(t, p) & ~target(t, p)).alias("ctx"), mask(lambda t: target(t, p)).alias("tgt")))
    if fallback == "span":
        other = span_masks(ratio, keyed(seed, f"{objective}.span", salt))
    else:
        other = block_masks(ratio, lambda p: keyed(seed, f"{objective}.block", salt, p))
    return let(own, lambda m: let(F.exists(m["tgt"], lambda b: b), lambda has: F.struct(F.when(has, m).otherwise(other).alias("m"), (~has).alias("fell_back"))))


def with_masks(examples: DataFrame, masks: Column) -> DataFrame:
    return examples.select("*", computed(masks, "_m")).select(*examples.columns, "_m.tgt", "_m.ctx")


def with_mask_v1(examples: DataFrame, objective: str, ratio: Column, seed: int = 0, salt: Column | None = None, fallback: str = "span") -> DataFrame:
    """``examples`` with the masks of ``masks_v1``."""
    rows = examples.select("*", computed(masks_v1(objective, ratio, seed, salt, fallback), "_m"))
    return rows.select(*examples.columns, "_m.m.tgt", "_m.m.ctx", "_m.fell_back")


# The second generation.


def _second(objective: str, rate: Column, u: Callable[..., Column]) -> Column:
    """The struct of both masks; null where ``next_obs`` does not apply."""
    eligible: Stage = lambda p: {"e": F.transform(F.filter("tok", lambda t: t["btype"] != GOAL), lambda t: t["pos"])}
    count: Stage = lambda p: {"k": F.size(p["e"]), "m": clipped_count(rate, F.size(p["e"]), F.size(p["e"]))}

    def between_ranks(first: Callable[[Params], Column], last: Callable[[Params], Column]) -> list[Stage]:
        """Positions of the first and the last eligible token of the target."""
        return [eligible, count, lambda p: {"i": first(p)}, lambda p: {"a": F.get(p["e"], p["i"]), "z": F.get(p["e"], last(p))}]

    inside: Predicate = lambda t, p: (t["btype"] != GOAL) & (t["pos"] >= p["a"]) & (t["pos"] <= p["z"])

    def imputed_from(p: Params) -> Column:
        low = (F.lit(0.10) * p["k"]).cast("int")
        return between(u("start"), low, F.least((F.lit(0.70) * p["k"]).cast("int"), F.greatest(low, p["k"] - p["m"])))

    spans = {
        "suffix": between_ranks(lambda p: p["k"] - p["m"], lambda p: p["k"] - 1),
        "retrodiction": between_ranks(lambda p: F.lit(0), lambda p: p["m"] - 1),
        "intermediate_imputation": between_ranks(imputed_from, lambda p: F.least(p["i"] + p["m"], p["k"]) - 1),
    }
    if objective == "random_block":
        return block_masks(rate, lambda p: u("block", p))
    if objective in spans:
        return bound(spans[objective], lambda p: masks_of(mask(lambda t: inside(t, p))))
    if objective == "obs_denoising":
        drawn = F.transform(F.filter("tok", lambda t: t["btype"] == OBS), lambda t: F.struct(u("obs", t["pos"]).alias("u"), t["pos"].alias("pos")))
        order: Stage = lambda p: {"o": F.array_sort(drawn)}
        last: Stage = lambda p: {"last": F.get(p["o"], clipped_count(rate, p["k"], F.size(p["o"])) - 1)}
        chosen: Predicate = lambda t, p: (t["btype"] == OBS) & (F.struct(u("obs", t["pos"]).alias("u"), t["pos"].alias("pos")) <= p["last"])
        return bound([eligible, count, order, last], lambda p: masks_of(mask(lambda t: chosen(t, p))))
    if objective == "inverse_dynamics":
        step: Stage = lambda p: {"t": let(steps_of(ACTION), lambda s: pick(s, u("t")))}
        seen: Predicate = lambda t, p: t["btype"].isin(GOAL, OBS) | (t["step"] != p["t"])
        own: Callable[[Params], Column] = lambda p: masks_of(mask(lambda t: (t["step"] == p["t"]) & (t["btype"] == ACTION)), mask(lambda t: seen(t, p)))
        return bound([step], lambda p: F.when(p["t"].isNotNull(), own(p)).otherwise(bound(spans["intermediate_imputation"], lambda q: masks_of(mask(lambda t: inside(t, q))))))
    if objective == "next_obs":
        last_step: Stage = lambda p: {"t": F.array_max(steps_of(OBS))}
        target: Predicate = lambda t, p: (t["step"] == p["t"]) & (t["btype"] == OBS)
        first: Stage = lambda p: {"first": first_token(lambda t: target(t, p))["pos"]}
        return bound([last_step, first], lambda p: F.when(p["first"] > 0, masks_of(mask(lambda t: target(t, p)), mask(lambda t: t["pos"] < p["first"]))))
    raise ValueError(f"no objective {objective}")


def masks_v2(objective: str, rate: Column, seed: int = 0, salt: Column | None = None) -> Column:
    """The struct of both masks of an objective of the second generation.

    random_block, suffix, the four bidirectional objectives, next_obs, and the causal five with random tokens as fallback.
    Without eligible tokens the target is empty and everything is context. ``next_obs`` is null where it does not apply.
    """
    if objective in CAUSAL_OBJECTIVES:
        return masks_v1(objective, rate, seed, salt, "block")["m"]
    return _second(objective, rate, lambda purpose, *more: keyed(seed, f"{objective}.{purpose}", salt, *more))


def with_mask_v2(examples: DataFrame, objective: str, rate: Column, seed: int = 0, salt: Column | None = None) -> DataFrame:
    """``examples`` with the masks of ``masks_v2``."""
    return with_masks(examples, masks_v2(objective, rate, seed, salt))


#: The objectives of each set of the second generation (fixed values).
OBJECTIVE_SETS = {"random_block": ["random_block"], "d_ar": ["suffix"], "d_flex": BIDIRECTIONAL_OBJECTIVES, "causal": CAUSAL_OBJECTIVES}


def by_objective(names: list[str], masks: Callable[[str], Column]) -> Column:
    """The masks of each row's own ``objective``; of no other are any computed."""
    own = F.when(F.col("objective") == names[0], masks(names[0]))
    for name in names[1:]:
        own = own.when(F.col("objective") == name, masks(name))
    return own


def with_drawn_mask_v2(examples: DataFrame, objective_set: str, rate: Column, seed: int = 0, salt: Column | None = None) -> DataFrame:
    """Each example with a mask of one objective of the set; several have the same chance. Adds ``objective``."""
    names = OBJECTIVE_SETS[objective_set]
    rows = examples.withColumn("objective", pick(F.array(*map(F.lit, names)), keyed(seed, "objective", salt)))
    return with_masks(rows, by_objective(names, lambda name: masks_v2(name, rate, seed, salt)))


def mask_summary(rows: DataFrame, *keep: str) -> DataFrame:
    """Per example: tokens, and of context and target their number, sum of positions and of squares."""

    def total(flags: str, power: int) -> Column:
        value = F.zip_with("tok", flags, lambda t, b: F.when(b, F.pow(t["pos"].cast("double"), F.lit(power))).otherwise(F.lit(0.0)))
        return F.aggregate(value, F.lit(0.0), lambda a, x: a + x).cast("long")

    sums = [total(flags, power).alias(f"{flags}_{name}") for flags in ("ctx", "tgt") for power, name in ((0, "n"), (1, "pos"), (2, "sq"))]
    return rows.select("traj_no", *keep, F.col("n").cast("long").alias("n"), *sums)


__all__ = ["OBJECTIVES", "OBJECTIVE_SETS", "by_objective", "mask_summary", "masks_v1", "masks_v2", "with_drawn_mask_v2", "with_mask_v1", "with_mask_v2", "with_masks"]

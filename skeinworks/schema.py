"""Types, codes and parameters of the trajectory model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Codes of block types (fixed values).
PAD, GOAL, THINK, ACTION, OBS = 0, 1, 2, 3, 4
BLOCK_CODES = {"Goal": GOAL, "Think": THINK, "Action": ACTION, "Observation": OBS}
CODE_NAMES = {GOAL: "goal", THINK: "think", ACTION: "action", OBS: "obs"}
#: Special ids of the word vocabulary (fixed values); every function takes them as parameters. One more is reserved.
PAD_ID, MASK_ID, UNK_ID = 0, 1, 2
N_SPECIAL = 4
#: Objectives in their order (fixed values).
CAUSAL_OBJECTIVES = ["next_action", "next_observation", "future_from_past", "full_completion", "goal_conditioned_action"]
FLEX_OBJECTIVES = ["inverse_dynamics", "retrodiction", "intermediate_imputation", "observation_denoising"]
OBJECTIVES = CAUSAL_OBJECTIVES + FLEX_OBJECTIVES
BIDIRECTIONAL_OBJECTIVES = ["intermediate_imputation", "retrodiction", "obs_denoising", "inverse_dynamics"]

BLOCK = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: A line of a JSONL dump. ``leakage_flags`` is a variant: its elements are objects or strings.
TRAJECTORY = T.StructType(
    [
        T.StructField("trajectory_id", T.StringType()),
        T.StructField("env", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("goal", T.StringType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("leakage_flags", T.VariantType()),
    ]
)

"""The queries of ``reference`` in SQL for DuckDB, written from the definitions and not from the Spark code."""

from __future__ import annotations

from skeinworks.functions.schedules import BASE_WEIGHTS, WARMUP
from skeinworks.functions.words import SPLIT_NAMES, WORD_SQL
from skeinworks.schema import BIDIRECTIONAL_OBJECTIVES, CAUSAL_OBJECTIVES, OBJECTIVES

MAX_LEN, V1_LEN, SHORT, RATE, VOCABULARY, STEPS, BATCH, VAL_BATCHES, SEED = 8192, 1024, 256, "0.2::double", 16_000, 24, 4, 3, 0


def split_of(column: str) -> str:
    bare = f"regexp_replace(lower({column}), '[^a-z]', '', 'g')"
    whens = " ".join(f"WHEN {bare} IN ({', '.join(repr(s) for s in spelt)}) THEN '{to}'" for to, spelt in SPLIT_NAMES.items())
    return f"CASE {whens} END"


def u(purpose: str, *keys: str) -> str:
    """The keyed uniform."""
    parts = " || '|' || ".join([f"'{SEED}|{purpose}'", *[f"({k})::varchar" for k in keys]])
    return f"(('0x' || substr(md5({parts}), 1, 8))::bigint / 4294967296.0::double)"


def pick(items: str, draw: str) -> str:
    return f"({items})[1 + floor({draw} * len({items}))::bigint]"


PRE = f"""
WITH traj AS (
  SELECT traj_no, {split_of('split')} AS split, blocks, leakage_flags FROM trajectories WHERE traj_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY traj_no ORDER BY loaded_at NULLS FIRST) = 1
), flags AS (
  SELECT traj_no, unnest(CASE WHEN json_valid(leakage_flags) AND json_type(leakage_flags) = 'ARRAY' THEN json_extract(leakage_flags, '$[*]') ELSE [] END) AS f FROM traj
), leak AS (
  SELECT DISTINCT traj_no, CASE json_type(f, '$.step') WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 's:' || (f ->> '$.step') ELSE 'n:' || (f ->> '$.step') END AS step_key
  FROM flags WHERE json_type(f, '$.step') IS NOT NULL
), blk AS (
  SELECT traj_no, split, i - 1 AS block_no, blocks[i].step AS step, blocks[i].type AS type, blocks[i].text AS text
  FROM (SELECT traj_no, split, blocks, unnest(generate_series(1, len(blocks))) AS i FROM traj)
), typed AS (
  SELECT *, CASE type WHEN 'Goal' THEN 1 WHEN 'Think' THEN 2 WHEN 'Action' THEN 3 WHEN 'Observation' THEN 4 END AS code,
    regexp_extract_all(lower(text), '{WORD_SQL}') AS toks,
    type = 'Think' AND EXISTS (SELECT 1 FROM leak l WHERE l.traj_no = blk.traj_no AND l.step_key = coalesce('n:' || blk.step, 'null')) AS leaky
  FROM blk
), dense AS (
  SELECT traj_no, code, coalesce(step, -1) AS step, toks, row_number() OVER (PARTITION BY traj_no ORDER BY block_no) - 1 AS bidx
  FROM typed WHERE code IS NOT NULL AND len(toks) > 0 AND NOT leaky
), tok AS (
  SELECT traj_no, row_number() OVER (PARTITION BY traj_no ORDER BY bidx, j) - 1 AS pos, token, code::bigint AS btype, step::bigint AS step, bidx
  FROM (SELECT traj_no, bidx, code, step, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS j FROM dense)
), ex AS (
  SELECT traj_no, split, coalesce(n, 0) AS n FROM traj LEFT JOIN (SELECT traj_no, count(*) AS n FROM tok GROUP BY traj_no) USING (traj_no)
), m AS (
  SELECT tok.*, ex.n, ex.split FROM tok JOIN ex USING (traj_no) WHERE ex.n BETWEEN 1 AND {MAX_LEN}
)"""

#: The same with the examples of the first generation, cut and not dropped.
CUT = f"SELECT tok.*, least(ex.n, {V1_LEN}) AS n, ex.split FROM tok JOIN ex USING (traj_no) WHERE tok.pos < {V1_LEN}"
WHOLE = f"SELECT tok.*, ex.n, ex.split FROM tok JOIN ex USING (traj_no) WHERE ex.n BETWEEN 1 AND {MAX_LEN}"
PRE_V1 = PRE.replace(WHOLE, CUT)

ORACLES: dict[str, str] = {
    "tokenize": PRE + " SELECT traj_no, block_no, len(toks) AS tokens, md5(array_to_string(toks, ' ')) AS digest FROM typed WHERE text IS NOT NULL",
    "block_counts": PRE + " SELECT type, count(*) AS blocks FROM blk GROUP BY type",
    "leak_set": PRE + " SELECT traj_no, step_key FROM leak",
    "drop_leaky_think": PRE + " SELECT traj_no, block_no FROM typed WHERE leaky",
    "flatten_tokens": PRE + " SELECT traj_no, pos, token, btype, step, bidx FROM tok",
    "dense_bidx": PRE + " SELECT traj_no, bidx, code::bigint AS btype, step::bigint AS step, len(toks) AS tokens FROM dense",
    "truncate_prefix": PRE + f""", cut AS (SELECT * FROM tok WHERE pos < {SHORT})
      SELECT traj_no, count(*) AS n, max_by(token, pos) AS last_token, max_by(bidx, pos) AS last_bidx, max_by(step, pos) AS last_step FROM cut GROUP BY traj_no""",
    "drop_overlong": PRE + f" SELECT traj_no, split, n FROM ex WHERE n BETWEEN 1 AND {SHORT}",
    "dropped_count": PRE + f" SELECT split, count(*) FILTER (n BETWEEN 1 AND {SHORT}) AS kept, count(*) FILTER (n = 0 OR n > {SHORT}) AS dropped FROM ex GROUP BY split",
    "steps_present": PRE + """, s AS (SELECT traj_no, list_sort(list_distinct(coalesce(list(step) FILTER (step >= 1), []))) AS s FROM tok GROUP BY traj_no)
      SELECT traj_no, len(s) AS steps, array_to_string(s, ',') AS list FROM s""",
    "action_blocks": PRE + """ SELECT traj_no, count(DISTINCT bidx) FILTER (bidx <> 0) AS interior,
      array_to_string(list_sort(list_distinct(coalesce(list(bidx) FILTER (btype = 3), []))), ',') AS actions FROM tok GROUP BY traj_no""",
    "first_index": PRE + " SELECT traj_no, step, btype, min(pos) AS first_pos FROM tok WHERE step >= 1 GROUP BY traj_no, step, btype",
    "last_obs_step": PRE + " SELECT traj_no, coalesce(max(step) FILTER (btype = 4 AND step >= 1), -1) AS step FROM tok GROUP BY traj_no",
    "splits_loaded": f"""WITH one AS (SELECT traj_no, split FROM trajectories WHERE traj_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY traj_no ORDER BY loaded_at NULLS FIRST) = 1)
      SELECT {split_of('split')} AS name, count(DISTINCT split) AS spellings, count(*) AS rows FROM one GROUP BY 1""",
    "manifest_splits": PRE + """, t AS (SELECT traj_no, sum(len(toks)) AS tokens FROM typed GROUP BY traj_no)
      SELECT split, count(*) AS trajectories, sum(coalesce(tokens, 0))::bigint AS tokens FROM traj LEFT JOIN t USING (traj_no) GROUP BY split""",
    "manifest_flags": PRE + " SELECT CASE WHEN json_type(f) = 'OBJECT' THEN f ->> '$.type' END AS type, count(*) AS flags FROM flags GROUP BY 1",
    "manifest_flagged": PRE + " SELECT count(DISTINCT traj_no) AS records_flagged, count(*) AS total_flags FROM flags",
    "name_extract": "SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, 'node-([a-z]+)', 1)) AS name FROM documents)",
    "leaf_segments": """WITH leaf AS (SELECT DISTINCT list_last(string_split(regexp_replace(trajectory_id, '[-/:_]', '.', 'g'), '.')) AS leaf FROM trajectories WHERE trajectory_id IS NOT NULL),
      any_kept AS (SELECT bool_or(regexp_matches(lower(leaf), 'attempt|run')) AS kept FROM leaf)
      SELECT leaf FROM leaf, any_kept WHERE CASE WHEN kept THEN regexp_matches(lower(leaf), 'attempt|run') ELSE NOT regexp_matches(lower(leaf), 'try') END""",
}

# Vocabulary: all blocks of the training split before any filter; ties by first occurrence.

VOCAB = PRE + f""", words AS (
  SELECT traj_no, block_no, unnest(toks) AS token, unnest(generate_series(1, len(toks))) - 1 AS pos FROM typed WHERE split = 'train'
), freq AS (
  SELECT token, count(*) AS n, min((traj_no, block_no, pos)) AS first FROM words GROUP BY token
), stoi AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, first) + 3 AS id FROM freq QUALIFY id < {VOCABULARY}
)"""
ORACLES |= {
    "token_freq": VOCAB + " SELECT token, n FROM freq",
    "vocab_topk": VOCAB + " SELECT token, id FROM stoi",
    "encode_unk": VOCAB + " SELECT traj_no, pos, coalesce(id, 2) AS id FROM tok LEFT JOIN stoi USING (token)",
    "encode_given_vocab": PRE + """ SELECT traj_no, count(*) AS tokens, count(*) FILTER (coalesce(id, 2) = 2) AS unknown, sum(coalesce(id, 2) * (pos + 1))::bigint AS checksum
      FROM tok LEFT JOIN vocab USING (token) GROUP BY traj_no""",
}

# Masks: parameters per trajectory (p), a predicate for context and target, and what to fall back on.

def masked(params: str, context: str, target: str, fallback: str, name: str, ratio: str = RATE, source: str = PRE, keys: tuple = (), empty_ok: bool = False) -> str:
    """CTEs up to ``masked`` (traj_no, pos, ..., ctx, tgt, fell_back); ``params`` selects one row per trajectory from m."""
    by = ", ".join(["traj_no", *keys])
    draw = u(f"{name}.block", "traj_no", *keys, "pos")
    start = u(f"{name}.span", "traj_no", *keys)
    if fallback == "span":
        other = f"""pos >= floor({start} * (greatest(0, n - greatest(1, trunc({ratio} * n)::bigint)) + 1))::bigint
          AND pos < floor({start} * (greatest(0, n - greatest(1, trunc({ratio} * n)::bigint)) + 1))::bigint + greatest(1, trunc({ratio} * n)::bigint)"""
    elif fallback == "block":
        other = f"btype <> 1 AND ({draw} < {ratio} OR (first_drawn >= {ratio} AND pos = first_pos))"
    else:
        other = "false"
    least = f", blocked AS (SELECT {by}, min(b) AS first_drawn, min_by(pos, b) AS first_pos FROM (SELECT {by}, pos, {draw} AS b FROM m WHERE btype <> 1) GROUP BY {by})" if fallback == "block" else ""
    join = f" LEFT JOIN blocked USING ({by})" if fallback == "block" else ""
    return f"""{source}{least}, p AS ({params}), judged AS (
      SELECT m.*, coalesce({target}, false) AS t0, coalesce({context}, false) AS c0, {other} AS f0 FROM m LEFT JOIN p USING ({by}){join}
    ), found AS (
      SELECT *, bool_or(t0) OVER (PARTITION BY {by}) OR {str(empty_ok).lower()} AS has FROM judged
    ), masked AS (
      SELECT *, CASE WHEN has THEN t0 ELSE f0 END AS tgt, CASE WHEN has THEN c0 AND NOT t0 ELSE NOT f0 END AS ctx, NOT has AS fell_back FROM found
    )"""


SUMS = """count(*) AS n, count(*) FILTER (ctx) AS ctx_n, coalesce(sum(pos) FILTER (ctx), 0)::bigint AS ctx_pos, coalesce(sum(pos * pos) FILTER (ctx), 0)::bigint AS ctx_sq,
  count(*) FILTER (tgt) AS tgt_n, coalesce(sum(pos) FILTER (tgt), 0)::bigint AS tgt_pos, coalesce(sum(pos * pos) FILTER (tgt), 0)::bigint AS tgt_sq"""


def sorted_of(field: str, where: str) -> str:
    return f"list_sort(list_distinct(coalesce(list({field}) FILTER ({where}), [])))"


def first_k(field: str, where: str, k: str, draw: str, by: str = "traj_no") -> str:
    """Per trajectory the ``k`` values with the least draws; ``k`` may use ``c``, their number."""
    return f"SELECT {by}, list(v ORDER BY d, v)[1:({k})::bigint] AS chosen FROM (SELECT *, {draw} AS d, count(*) OVER (PARTITION BY {by}) AS c FROM (SELECT DISTINCT {by}, {field} AS v, RATIO AS ratio FROM m WHERE {where})) GROUP BY {by}, c, ratio"


def v1(name: str, ratio: str = RATE, keys: tuple = ()) -> tuple[str, str, str]:
    """Parameters, context and target of an objective of the first generation."""
    by = ", ".join(["traj_no", *keys])
    draw = lambda purpose, *more: u(f"{name}.{purpose}", "traj_no", *keys, *more)
    if name in ("next_action", "next_observation", "inverse_dynamics", "observation_denoising"):
        kind = 3 if name in ("next_action", "inverse_dynamics") else 4
        t = f"SELECT {by}, {pick('c', draw('t'))} AS t FROM (SELECT {by}, {sorted_of('step', f'step >= 1 AND btype = {kind}')} AS c FROM m GROUP BY {by})"
        p = f"""SELECT {by}, t, min(pos) FILTER (step = t AND btype = {kind}) AS first, min_by(bidx, pos) FILTER (step = t AND btype = {kind}) AS b,
          bool_or(btype = 4 AND step IN (t, t + 1)) AS seen FROM m JOIN ({t}) USING ({by}) GROUP BY {by}, t"""
        target = f"step = t AND btype = {kind}"
        context = {
            "inverse_dynamics": "CASE WHEN seen THEN btype = 4 AND step IN (t, t + 1) ELSE step = t AND btype <> 3 END",
            "observation_denoising": "btype = 1 OR bidx IN (b - 1, b + 1)",
        }.get(name, "pos < first")
        return p, context, target
    steps = f"SELECT {by}, {sorted_of('step', 'step >= 1')} AS s FROM m GROUP BY {by}"
    if name == "future_from_past":
        p = f"SELECT {by}, {pick('(CASE WHEN len(s) > 1 THEN s[:-2] ELSE s END)', draw('t'))} AS t FROM ({steps})"
        return p, "step <= t OR btype = 1", "NOT (step <= t OR btype = 1)"
    if name == "retrodiction":
        p = f"SELECT {by}, {pick('(CASE WHEN len(s) > 1 THEN s[2:] ELSE s END)', draw('t'))} AS t FROM ({steps})"
        return p, "step >= t", "step >= 1 AND step < t"
    if name == "intermediate_imputation":
        two = first_k("step", "step >= 1", "CASE WHEN c >= 3 THEN 2 ELSE 0 END", draw("pair", "v"), by).replace("RATIO", "0")
        p = f"SELECT {by}, list_min(chosen) AS a, list_max(chosen) AS z FROM ({two})"
        return p, "step <= a OR step >= z OR btype = 1", "NOT (step <= a OR step >= z OR btype = 1)"
    if name == "full_completion":
        kept = first_k("bidx", "bidx <> 0", "greatest(0, round_even((1.0::double - ratio) * c, 0))", draw("keep", "v"), by).replace("RATIO", ratio)
        p = f"SELECT {by}, coalesce(chosen, []) AS kept FROM (SELECT DISTINCT {by} FROM m WHERE step >= 1) LEFT JOIN ({kept}) USING ({by})"
        return p, "btype = 1 OR bidx = 0 OR list_contains(kept, bidx)", "NOT (btype = 1 OR bidx = 0 OR list_contains(kept, bidx))"
    acts = first_k("bidx", "btype = 3", "greatest(1, round_even(ratio * c, 0))", draw("act", "v"), by).replace("RATIO", ratio)
    p = f"""SELECT {by}, chosen, min(step) FILTER (list_contains(chosen, bidx)) AS since FROM m JOIN ({acts}) USING ({by}) JOIN (SELECT DISTINCT {by} FROM m WHERE step >= 1) USING ({by}) GROUP BY {by}, chosen"""
    return p, "NOT (btype = 4 AND step > since)", "list_contains(chosen, bidx)"


def v2(name: str, ratio: str = RATE, keys: tuple = ()) -> tuple[str, str, str, str]:
    """The same for the second generation, and its fallback."""
    if name in CAUSAL_OBJECTIVES:
        return *v1(name, ratio, keys), "block"
    by = ", ".join(["traj_no", *keys])
    draw = lambda purpose, *more: u(f"{name}.{purpose}", "traj_no", *keys, *more)
    count = f"greatest(1, least(round_even({ratio} * e, 0)::bigint, e))"
    ranked = f"SELECT *, count(*) OVER (PARTITION BY {by}) AS e, row_number() OVER (PARTITION BY {by} ORDER BY pos) AS r FROM m WHERE btype <> 1"
    low = "trunc(0.10::double * e)::bigint"
    start = f"{low} + floor({draw('start')} * (least(trunc(0.70::double * e)::bigint, greatest({low}, e - {count})) - {low} + 1))::bigint"
    some = {
        "suffix": f"r > e - {count}",
        "retrodiction": f"r <= {count}",
        "intermediate_imputation": f"r > {start} AND r <= {start} + {count}",
    }
    if name == "random_block":
        return f"SELECT DISTINCT {by} FROM m", "false", "false", "block"
    if name in some:
        return f"SELECT {by}, list(pos) AS chosen FROM ({ranked}) WHERE {some[name]} GROUP BY {by}", "NOT coalesce(list_contains(chosen, pos), false)", "list_contains(chosen, pos)", "none"
    if name == "obs_denoising":
        of = f"SELECT {by}, count(*) FILTER (btype <> 1) AS e FROM m GROUP BY {by}"
        p = f"""SELECT {by}, list(pos) AS chosen FROM (SELECT m.*, e, count(*) OVER (PARTITION BY {by}) AS o, row_number() OVER (PARTITION BY {by} ORDER BY {draw('obs', 'pos')}, pos) AS r
          FROM m JOIN ({of}) USING ({by}) WHERE btype = 4) WHERE r <= greatest(1, least(round_even({ratio} * e, 0)::bigint, o)) GROUP BY {by}"""
        return p, "NOT coalesce(list_contains(chosen, pos), false)", "list_contains(chosen, pos)", "none"
    if name == "inverse_dynamics":
        t = f"SELECT {by}, {pick('c', draw('t'))} AS t FROM (SELECT {by}, {sorted_of('step', 'step >= 1 AND btype = 3')} AS c FROM m GROUP BY {by})"
        p = f"SELECT {by}, t, chosen FROM ({t}) LEFT JOIN (SELECT {by}, list(pos) AS chosen FROM ({ranked}) WHERE {some['intermediate_imputation']} GROUP BY {by}) USING ({by})"
        return p, "CASE WHEN t IS NULL THEN NOT coalesce(list_contains(chosen, pos), false) ELSE btype IN (1, 4) OR step <> t END", "CASE WHEN t IS NULL THEN list_contains(chosen, pos) ELSE step = t AND btype = 3 END", "none"
    p = f"SELECT {by}, t, min(pos) FILTER (step = t AND btype = 4) AS first FROM m JOIN (SELECT {by}, max(step) FILTER (step >= 1 AND btype = 4) AS t FROM m GROUP BY {by}) USING ({by}) GROUP BY {by}, t"
    return p, "pos < first", "step = t AND btype = 4", "none"


for _name in OBJECTIVES:
    ORACLES[f"{_name}_v1"] = masked(*v1(_name), "span", _name, source=PRE_V1) + f" SELECT traj_no, fell_back, {SUMS} FROM masked GROUP BY traj_no, fell_back"
for _name in ["random_block", "suffix", *BIDIRECTIONAL_OBJECTIVES, *CAUSAL_OBJECTIVES]:
    *_p, _fallback = v2(_name)
    ORACLES[f"{_name}_v2"] = masked(*_p, _fallback, _name, empty_ok=_fallback == "none") + f" SELECT traj_no, {SUMS} FROM masked GROUP BY traj_no"
*_p, _ = v2("next_obs")
NEXT_OBS = masked(*_p, "none", "next_obs") + ", ok AS (SELECT masked.* FROM masked JOIN p USING (traj_no) WHERE first > 0)"
ORACLES["next_obs_v2"] = NEXT_OBS + f" SELECT traj_no, {SUMS} FROM ok GROUP BY traj_no"
ORACLES["next_obs_check"] = NEXT_OBS + """ SELECT (SELECT count(DISTINCT traj_no) FROM m) AS examples, count(DISTINCT traj_no) AS masked,
  coalesce((SELECT bool_and(a < b) FROM (SELECT max(pos) FILTER (ctx) AS a, min(pos) FILTER (tgt) AS b FROM ok GROUP BY traj_no)), true) AS causal, coalesce(bool_or(tgt AND btype = 1), false) AS goal_leak FROM ok"""
*_p, _ = v2("inverse_dynamics")
ORACLES["inverse_dynamics_check"] = masked(*_p, "none", "inverse_dynamics", empty_ok=True) + """, acted AS (
  SELECT traj_no, min(step) FILTER (tgt AND btype = 3) AS s, count(DISTINCT step) FILTER (tgt AND btype = 3) AS k FROM masked GROUP BY traj_no
) SELECT count(*) AS examples, count(*) FILTER (hid) AS thoughts_hidden, count(*) FILTER (seen) AS later_seen FROM (
  SELECT traj_no, bool_and(NOT (btype = 2 AND step = s) OR (NOT ctx AND NOT tgt)) AS hid, bool_and(NOT (btype = 4 AND step > s) OR ctx) AS seen
  FROM masked JOIN acted USING (traj_no) WHERE k = 1 GROUP BY traj_no)"""

*_p, _ = v2("suffix")
SUFFIX = masked(*_p, "none", "suffix", empty_ok=True)
BUDGET = "count(*) FILTER (tgt AND btype = 1) AS goal, count(*) FILTER (tgt AND btype = 2) AS think, count(*) FILTER (tgt AND btype = 3) AS action, count(*) FILTER (tgt AND btype = 4) AS obs"
ORACLES |= {
    "budget_suffix_v2": SUFFIX + f" SELECT {BUDGET}, round(count(*) FILTER (tgt) / greatest(count(*) FILTER (btype <> 1), 1), 6) AS rate, count(DISTINCT traj_no) AS trajectories FROM masked",
    "achieved_rate": SUFFIX + " SELECT traj_no, round(count(*) FILTER (tgt) / greatest(count(*) FILTER (btype <> 1), 1), 6) AS rate FROM masked GROUP BY traj_no",
}


def dispatched(objective_set: list[str]) -> str:
    """The masks of each trajectory's own objective."""
    names = "[" + ", ".join(repr(x) for x in objective_set) + "]"
    parts = []
    for name in objective_set:
        *p, fallback = v2(name)
        sql = masked(*p, fallback, name, source="WITH whole AS (SELECT 1)", empty_ok=fallback == "none").replace("WITH whole AS (SELECT 1), ", "", 1)
        parts.append(f"(WITH m AS (SELECT * FROM drawn WHERE objective = '{name}'), {sql} SELECT traj_no, objective, {SUMS} FROM masked GROUP BY traj_no, objective)")
    return PRE + f", drawn AS (SELECT *, {pick(names, u('objective', 'traj_no'))} AS objective FROM m) " + " UNION ALL ".join(parts)


ORACLES["dispatch_d_flex"] = dispatched(BIDIRECTIONAL_OBJECTIVES)
ORACLES["dispatch_causal"] = dispatched(CAUSAL_OBJECTIVES)

# Plans, schedules, corruption.

PLANNED = PRE + f""", rows AS (
  SELECT traj_no, n, row_number() OVER (ORDER BY traj_no) - 1 AS row_no FROM ex WHERE split = 'train' AND n BETWEEN 1 AND {MAX_LEN}
), slots AS (
  SELECT s AS train_step, k AS slot FROM generate_series(0, {STEPS - 1}) a(s), generate_series(0, {BATCH - 1}) b(k)
), replaced AS (
  SELECT train_step, slot, floor({u('batch', 'train_step', 'slot')} * (SELECT count(*) FROM rows))::bigint AS row_no FROM slots
), draws AS (
  SELECT s AS train_step, floor({u('sample', 's', 'k')} * (SELECT count(*) FROM rows))::bigint AS row_no, min(k) AS place
  FROM generate_series(0, {STEPS - 1}) a(s), generate_series(0, {8 * BATCH + 63}) b(k) GROUP BY 1, 2
), distinct_rows AS (
  SELECT train_step, row_number() OVER (PARTITION BY train_step ORDER BY place) - 1 AS slot, row_no FROM draws
)"""
WEIGHTS = {}
for _name, _w in BASE_WEIGHTS.items():
    _low, _high = WARMUP.get(_name, (None, None))
    WEIGHTS[_name] = f"{_w}::double" if _low is None else f"{_w}::double * (CASE WHEN p <= {_low} THEN 0.0::double WHEN p >= {_high} THEN 1.0::double ELSE (p - {_low}::double) / {_high - _low!r}::double END)"
TOTAL = " + ".join(["0.0::double", *WEIGHTS.values()])


def drawn_objective(draw: str) -> str:
    whens, upto = [], "0.0::double"
    for name, w in WEIGHTS.items():
        upto += f" + {w}"
        whens.append(f"WHEN {draw} * ({TOTAL}) <= {upto} THEN '{name}'")
    return f"(CASE {' '.join(whens)} ELSE '{list(WEIGHTS)[-1]}' END)"


THOUSAND = "WITH steps AS (SELECT s AS train_step, s / 999.0::double AS p FROM generate_series(0, 999) a(s))"
NOISE = f"(0.001::double + {{}} * 0.998::double)"
ORACLES |= {
    "sample_with_replacement": PLANNED + " SELECT train_step, slot, traj_no FROM replaced JOIN rows USING (row_no)",
    "sample_without_replacement": PLANNED + f" SELECT train_step, slot, traj_no FROM distinct_rows JOIN rows USING (row_no) WHERE slot < {BATCH}",
    "objective_schedule": THOUSAND + f", o AS (SELECT train_step, {drawn_objective(u('objective', 'train_step'))} AS objective FROM steps) SELECT train_step, objective, list_position({OBJECTIVES!r}, objective)::bigint - 1 AS ordinal FROM o",
    "objective_weights": THOUSAND + " SELECT train_step, " + ", ".join(f"round({w}, 6) AS {name}" for name, w in WEIGHTS.items()) + " FROM steps",
    "curriculum": THOUSAND + f" SELECT train_step, round(0.1::double + 0.5::double * least(greatest(p, 0.0::double), 1.0::double), 6) AS ratio, round(0.1::double + 0.5::double * p, 6) AS rate, {RATE} AS constant FROM steps",
    "noise_weights": THOUSAND + f" SELECT train_step, round({NOISE.format(u('t', 'train_step'))}, 6) AS t, round(least(50.0::double, 1.0::double / greatest({NOISE.format(u('t', 'train_step'))}, 0.01::double)), 6) AS weight FROM steps",
}

CODED = "(SELECT masked.*, coalesce(id, 2) AS id FROM masked LEFT JOIN vocab USING (token))"


def laid_out(scored: str, by: str = "traj_no", extra: str = "", width: str = "count(*)") -> str:
    """Sums over aligned arrays from rows with ``id``, ``scored``, ``ctx``, ``tgt``."""
    hidden = "NOT ctx AND NOT tgt"
    return f"""SELECT {by}{extra}, {width} AS width, sum((CASE WHEN {scored} OR ({hidden}) THEN 1 ELSE id END) * (pos + 1))::bigint AS inp, sum(id * (pos + 1))::bigint AS labels,
      sum(btype * (pos + 1))::bigint AS btypes, sum(pos + 1)::bigint AS valid, coalesce(sum(pos + 1) FILTER ({scored}), 0)::bigint AS scored"""


*_p, _ = v2("inverse_dynamics")
INVERSE = masked(*_p, "none", "inverse_dynamics", empty_ok=True)
ORACLES |= {
    "corrupt_v1": masked(*v1("next_observation"), "span", "next_observation", source=PRE_V1)
    + f""", scored AS (SELECT *, {u('corrupt', 'traj_no', 'pos')} AS d FROM {CODED}), marked AS (
      SELECT *, tgt AND (d < 0.3::double OR (min(CASE WHEN tgt THEN d END) OVER (PARTITION BY traj_no) >= 0.3::double AND pos = min_by(pos, CASE WHEN tgt THEN d END) OVER (PARTITION BY traj_no))) AS sc FROM scored
    ) {laid_out('sc')} FROM marked GROUP BY traj_no""",
    "corrupt_v2": INVERSE + f" {laid_out('tgt')} FROM {CODED} GROUP BY traj_no",
    "pad_static": SUFFIX.replace(WHOLE, CUT) + f" {laid_out('tgt', width=f'{V1_LEN}::bigint')} FROM {CODED} GROUP BY traj_no",
    "masked_preview": SUFFIX + " SELECT traj_no, string_agg(CASE WHEN tgt THEN '[MASK]' ELSE token END, ' ' ORDER BY pos) FILTER (pos < 60) AS preview FROM masked GROUP BY traj_no",
}

# Losses: values of the suffix mask over sampled batches; the nll is a keyed draw.

LOSSES = SUFFIX.replace(PRE, PLANNED) + f""", tokens AS (
  SELECT train_step, slot, slot // 2 AS micro, {pick('[' + ', '.join(repr(x) for x in BIDIRECTIONAL_OBJECTIVES) + ']', u('slot.objective', 'train_step', 'slot'))} AS objective,
    {NOISE.format(u('t', 'train_step', 'slot'))} AS t, pos, btype, tgt AS scored, 6.0::double * {u('nll', 'train_step', 'slot', 'pos')} AS nll
  FROM replaced JOIN rows USING (row_no) JOIN masked USING (traj_no)
), step_loss AS (
  SELECT train_step, coalesce(sum(nll) FILTER (scored), 0.0::double) / greatest(count(*) FILTER (scored), 1) AS loss FROM tokens GROUP BY train_step
)"""
HISTORY = f"WITH hist AS (SELECT s AS train_step, CASE WHEN s % 10 = 9 THEN 'nan'::double ELSE 10.0::double * {u('history', 's')} END AS loss FROM generate_series(0, {{}}) a(s))"


def smooth(k: int, steps: int) -> str:
    return HISTORY.format(steps - 1) + f""", h AS (SELECT train_step, CASE WHEN isnan(loss) THEN 0.0::double ELSE loss END AS loss, count(*) OVER () AS n FROM hist)
      SELECT train_step, round(CASE WHEN n < {k} THEN loss ELSE avg(loss) OVER (ORDER BY train_step ROWS {k - 1} PRECEDING) END, 6) AS smooth FROM h QUALIFY n < {k} OR row_number() OVER (ORDER BY train_step) >= {k}"""


ORACLES |= {
    "masked_loss_weighted": LOSSES + """ SELECT train_step, round(coalesce(sum(nll * least(50.0::double, 1.0::double / greatest(t, 0.01::double))) FILTER (scored), 0.0::double) / greatest(count(*) FILTER (scored), 1), 6) AS loss
      FROM tokens GROUP BY train_step""",
    "masked_loss_plain": LOSSES + " SELECT train_step, round(loss, 6) AS loss FROM step_loss",
    "accum_mean": LOSSES + """ SELECT train_step, round(sum(loss) / 2, 6) AS loss FROM (SELECT train_step, micro, coalesce(sum(nll) FILTER (scored), 0.0::double) / greatest(count(*) FILTER (scored), 1) AS loss
      FROM tokens GROUP BY train_step, micro) GROUP BY train_step""",
    "supervision_budget": LOSSES + " SELECT " + BUDGET.replace("tgt", "scored") + " FROM tokens",
    "obj_mean": LOSSES + f" SELECT objective, round(avg(loss), 6) AS loss FROM (SELECT {drawn_objective(u('objective', 'train_step'))} AS objective, loss FROM (SELECT *, train_step / {STEPS - 1}.0::double AS p FROM step_loss)) GROUP BY objective",
    "obj_fractional_mean": LOSSES + """, share AS (SELECT *, 1.0::double / count(*) OVER (PARTITION BY train_step) AS share FROM (SELECT DISTINCT train_step, slot, objective FROM tokens))
      SELECT objective, round(sum(loss * share) / sum(share), 6) AS loss FROM share JOIN step_loss USING (train_step) GROUP BY objective""",
    "mean_rate_macro": LOSSES + " SELECT round(avg(rate), 6) AS mean_rate FROM (SELECT count(*) FILTER (scored) / greatest(count(*) FILTER (btype <> 1), 1) AS rate FROM tokens GROUP BY train_step)",
    "best_non_nan": HISTORY.format(399) + " SELECT round(min(loss) FILTER (NOT isnan(loss)), 6) AS best FROM hist",
    "last_value": HISTORY.format(399) + " SELECT round(max_by(loss, train_step), 6) AS last FROM hist WHERE NOT isnan(loss)",
    "smooth_k15": smooth(15, 400),
    "smooth_k25": smooth(25, 400),
    "smooth_short": smooth(25, 20),
}

# Batches: each drawn example under its own objective, with ids, over aligned positions.


def branches(objective_set: list[str], parts_of, ratio: str, keys: tuple) -> str:
    """A CTE ``batch`` with the masks of every row of ``drawn`` under its ``objective``; ``parts_of`` gives parameters, context, target, fallback."""
    parts = []
    for name in objective_set:
        *p, fallback = parts_of(name, ratio, keys)
        sql = masked(*p, fallback, name, ratio=ratio, source="WITH whole AS (SELECT 1)", keys=keys, empty_ok=fallback == "none").replace("WITH whole AS (SELECT 1), ", "", 1)
        parts.append(f"(WITH m AS (SELECT * FROM drawn WHERE objective = '{name}'), {sql} SELECT * EXCLUDE (t0, c0, f0, has) FROM masked)")
    return ", batch AS (" + " UNION ALL BY NAME ".join(parts) + ")"


DRAWN = """, drawn AS (
  SELECT {plan}.train_step, {plan}.slot, m.*, coalesce(vocab.id, 2) AS id, {more}
  FROM {plan} JOIN rows USING (row_no) JOIN m ON m.traj_no = rows.traj_no LEFT JOIN vocab USING (token) WHERE {plan}.slot < {most}
)"""
NAMED = "[" + ", ".join(repr(x) for x in BIDIRECTIONAL_OBJECTIVES) + "]"
STEP_RATE = f"(0.1::double + 0.5::double * (distinct_rows.train_step / {STEPS - 1}.0::double))"
BATCH_V2 = (
    PLANNED
    + DRAWN.format(plan="distinct_rows", most=BATCH, more=f"{STEP_RATE} AS rate, {pick(NAMED, u('objective', 'm.traj_no', 'distinct_rows.train_step'))} AS objective")
    + branches(BIDIRECTIONAL_OBJECTIVES, v2, "rate", ("train_step",))
)
ORACLES["pad_dynamic"] = (
    BATCH_V2
    + f""", wide AS (SELECT train_step, max(n) AS width FROM batch GROUP BY train_step)
      {laid_out('tgt', 'train_step, slot, traj_no, objective', width='any_value(width)')} FROM batch JOIN wide USING (train_step) GROUP BY train_step, slot, traj_no, objective"""
)
QUALITY = """, laid AS (SELECT *, CASE WHEN tgt OR (NOT ctx AND NOT tgt) THEN 1 ELSE id END AS inp FROM batch), tests AS (
      SELECT true AS mask_is_not_pad, bool_and(NOT (tgt AND btype = 1)) AS goal_never_scored, true AS no_pad_masked, true AS no_pad_scored,
        bool_and(NOT tgt OR inp = 1) AS scored_is_masked, bool_and(tgt OR inp = id OR inp = 1) AS rest_is_kept_or_masked,
        (SELECT bool_and(a = b) FROM (SELECT count(*) AS a, count(DISTINCT traj_no) AS b FROM (SELECT DISTINCT train_step, slot, traj_no FROM batch) GROUP BY train_step)) AS sampled_once
      FROM laid
    ) SELECT name, passed FROM (UNPIVOT tests ON COLUMNS(*) INTO NAME name VALUE passed)"""
ORACLES["quality_checks"] = BATCH_V2 + QUALITY
EVERY_V2 = (
    PRE
    + f""", drawn AS (
  SELECT m.*, floor((dense_rank() OVER (ORDER BY traj_no) - 1) / {BATCH})::bigint AS train_step, 0 AS slot, coalesce(vocab.id, 2) AS id, {RATE} AS rate, {pick(NAMED, u('objective', 'traj_no'))} AS objective
  FROM m LEFT JOIN vocab USING (token)
)"""
    + branches(BIDIRECTIONAL_OBJECTIVES, v2, "rate", ())
)
ORACLES["quality_checks_all"] = EVERY_V2 + QUALITY
STEP_RATIO = f"(0.1::double + 0.5::double * least(greatest(replaced.train_step / {STEPS - 1}.0::double, 0.0::double), 1.0::double))"
STEP_OBJECTIVE = drawn_objective(u("objective", "replaced.train_step")).replace("(p ", f"((replaced.train_step / {STEPS - 1}.0::double) ").replace(" p ", f" (replaced.train_step / {STEPS - 1}.0::double) ")
ORACLES["batch_v1"] = (
    PLANNED.replace(WHOLE, CUT)
    + DRAWN.format(
        plan="replaced",
        most=BATCH,
        more=f"{STEP_RATIO} AS ratio_at, replaced.train_step || '.' || replaced.slot AS salt, {STEP_OBJECTIVE} AS objective, {NOISE.format(u('t', 'replaced.train_step', 'replaced.slot'))} AS noise",
    )
    + branches(OBJECTIVES, lambda name, ratio, keys: (*v1(name, ratio, keys), "span"), "ratio_at", ("salt",))
    + f""", draws_of AS (SELECT *, {u('corrupt', 'traj_no', 'salt', 'pos')} AS d FROM batch), marked AS (
      SELECT *, tgt AND (d < noise OR (min(CASE WHEN tgt THEN d END) OVER w >= noise AND pos = min_by(pos, CASE WHEN tgt THEN d END) OVER w)) AS sc FROM draws_of WINDOW w AS (PARTITION BY traj_no, salt)
    ) {laid_out('sc', 'train_step, slot, traj_no, objective', ', round(noise, 6) AS t', f'{V1_LEN}::bigint')} FROM marked GROUP BY train_step, slot, traj_no, objective, noise"""
)


def validation(steps: int, k: int) -> str:
    """Up to ``tried`` (train_step, slot, row_no): ``k`` different rows of the validation split per step, in order of drawing."""
    return PRE + f""", rows AS (
  SELECT traj_no, n, row_number() OVER (ORDER BY traj_no) - 1 AS row_no, count(*) OVER () AS c FROM ex WHERE split = 'validation' AND n BETWEEN 1 AND {MAX_LEN}
), each_step AS (
  SELECT s AS train_step FROM generate_series(0, {steps - 1}) a(s)
), ordered AS (
  SELECT train_step, row_no, {u('order', 'train_step', 'row_no')} AS place FROM rows, each_step WHERE c <= {4 * k}
), sampled AS (
  SELECT train_step, floor({u('sample', 'train_step', 'k')} * (SELECT count(*) FROM rows))::bigint AS row_no, min(k)::double AS place
  FROM each_step, generate_series(0, {8 * k + 63}) b(k) WHERE (SELECT count(*) FROM rows) > {4 * k} GROUP BY 1, 2
), tried AS (
  SELECT train_step, row_no, row_number() OVER (PARTITION BY train_step ORDER BY place, row_no) - 1 AS slot FROM (SELECT * FROM ordered UNION ALL SELECT * FROM sampled) QUALIFY slot < {k}
)"""


*_p, _ = v2("next_obs")


def next_observations(steps: int) -> str:
    return masked(*_p, "none", "next_obs", source=validation(steps, 3 * BATCH)) + f""", kept AS (
      SELECT train_step, traj_no, row_number() OVER (PARTITION BY train_step ORDER BY slot) - 1 AS place FROM tried JOIN rows USING (row_no) JOIN p USING (traj_no) WHERE first > 0 QUALIFY place < {BATCH}
    )"""


ORACLES["nextobs_batch"] = (
    next_observations(1)
    + f""", laid AS (SELECT masked.*, place, coalesce(id, 2) AS id, max(n) OVER () AS width FROM masked JOIN kept USING (traj_no) LEFT JOIN vocab USING (token))
    {laid_out('tgt', 'place, traj_no', width='any_value(width)')} FROM laid GROUP BY place, traj_no"""
)
VAL_LOSS = f""", val_tokens AS (SELECT train_step, tgt AS scored, 6.0::double * {u('val.nll', 'train_step', 'traj_no', 'pos')} AS nll FROM val_rows
), val_steps AS (SELECT coalesce(sum(nll) FILTER (scored), 0.0::double) / greatest(count(*) FILTER (scored), 1) AS loss FROM val_tokens GROUP BY train_step
) SELECT round(coalesce(avg(loss), 'nan'::double), 6) AS val_loss FROM val_steps"""
ORACLES["validation_nextobs"] = next_observations(VAL_BATCHES) + ", val_rows AS (SELECT kept.train_step, masked.* FROM masked JOIN kept USING (traj_no))" + VAL_LOSS
ORACLES["validation_mean"] = (
    validation(VAL_BATCHES, BATCH)
    + f", drawn AS (SELECT tried.train_step, m.*, {pick(NAMED, u('objective', 'm.traj_no', 'tried.train_step'))} AS objective FROM tried JOIN rows USING (row_no) JOIN m ON m.traj_no = rows.traj_no)"
    + branches(BIDIRECTIONAL_OBJECTIVES, v2, RATE, ("train_step",))
    + ", val_rows AS (SELECT * FROM batch)"
    + VAL_LOSS
)
ORACLES["batch_objectives"] = (
    BATCH_V2
    + """ SELECT train_step, count(DISTINCT slot) AS examples, count(DISTINCT traj_no) AS different, array_to_string(list_sort(list_distinct(list(objective))), ',') AS objectives,
      round(any_value(rate), 6) AS target, round(count(*) FILTER (tgt) / greatest(count(*) FILTER (btype <> 1), 1), 6) AS achieved FROM batch GROUP BY train_step"""
)
ORACLES["examples_subword"] = (
    PRE
    + """, said AS (SELECT traj_no, block_no, text FROM typed WHERE code IS NOT NULL AND NOT leaky AND length(text) > 0)
    SELECT traj_no, sum(octet_length(encode(text)))::bigint AS n, count(*) AS blocks, md5(string_agg(hex(encode(text)), '' ORDER BY block_no)) AS digest FROM said GROUP BY traj_no"""
)
ORACLES |= {
    "jsonl_examples": PRE + " SELECT traj_no, split, n FROM ex",
    "vocabulary_round_trip": ORACLES["vocab_topk"],
    "document_keys": "SELECT unnest(['mask_token_id', 'pad_token_id', 'MaskFrom']) AS key, unnest([(max(id) + 1)::varchar, '0', min(id)::varchar]) AS value FROM vocab",
    "class_list": "SELECT DISTINCT regexp_extract(token, '^[A-Za-z0-9_]+') AS name FROM vocab WHERE regexp_matches(token, '^[A-Za-z0-9_]')",
    "metrics_document": PRE + " SELECT unnest(['trajectories', 'blocks']) AS key, unnest([(SELECT count(*) FROM traj)::varchar, (SELECT count(*) FROM blk)::varchar]) AS value",
    "progress_log": HISTORY.format(399) + " SELECT train_step AS step, 400::bigint AS steps, round(loss, 3) AS loss, round(loss / 2, 3) AS val_loss FROM hist WHERE train_step % 20 = 0",
    "parsed_lists": "SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '[\\s\\p{Z}\\x{0B}\\x{85}\\x{1c}-\\x{1f}]+', '', 'g')), lambda x: x <> '')) AS entries FROM documents WHERE text IS NOT NULL",
}

# The manifest as one JSON text: maps in order of their keys.


def json_map(source: str, key: str, value: str) -> str:
    return f"""(SELECT coalesce('{{' || string_agg(to_json(k) || ':' || v, ',' ORDER BY k) || '}}', '{{}}') FROM (SELECT coalesce({key}, 'unknown') AS k, {value} AS v FROM {source} GROUP BY ALL))"""


ORACLES["manifest_document"] = (
    PRE
    + """, tokens AS (SELECT traj.split, coalesce(t.n, 0) AS n FROM traj LEFT JOIN (SELECT traj_no, sum(len(toks)) AS n FROM typed GROUP BY traj_no) t USING (traj_no)),
    kinds AS (SELECT CASE WHEN json_type(f) = 'OBJECT' THEN f ->> '$.type' END AS type FROM flags)
    SELECT '{"block_type_counts":' || """
    + json_map("blk", "type", "count(*)")
    + """ || ',"leakage_audit":{"flags_by_type":' || """
    + json_map("kinds", "type", "count(*)")
    + """ || ',"records_flagged":' || (SELECT count(DISTINCT traj_no) FROM flags) || ',"total_flags":' || (SELECT count(*) FROM flags) || '},"token_counts":' || """
    + json_map("tokens", "split", "sum(n)::bigint")
    + """ || ',"trajectory_counts":' || """
    + json_map("traj", "split", "count(*)")
    + " || '}' AS manifest"
)

"""SQL that says the same as queries of this subpackage."""

from __future__ import annotations

from skeinworks.functions.words import SPLIT_NAMES, WORD_SQL

#: Terms of trajectories, each trajectory once, and the entries of the vocabulary.
TERMS = f"""
WITH once AS (
  SELECT traj_no, blocks FROM trajectories WHERE traj_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY traj_no ORDER BY loaded_at NULLS FIRST) = 1
), texts AS (
  SELECT traj_no, unnest(blocks).text AS text FROM once
), tokens AS (
  SELECT traj_no, unnest(regexp_extract_all(lower(text), '{WORD_SQL}')) AS term FROM texts WHERE text IS NOT NULL
), counted AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT traj_no) AS records FROM tokens GROUP BY term
), listed AS (
  SELECT DISTINCT token AS term FROM vocab WHERE token IS NOT NULL
), total AS (
  SELECT count(*) AS n FROM once
), terms AS (
  SELECT coalesce(c.term, l.term) AS term, coalesce(occurrences, 0)::bigint AS occurrences, coalesce(records, 0)::bigint AS records
  FROM counted c FULL JOIN listed l ON c.term = l.term
), marked AS (
  SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > n * 0.5::double THEN 'common' END AS mark FROM terms, total
)
"""

ORACLES = {
    "p4_merged": TERMS + "SELECT term, occurrences, records, mark FROM marked",
    "p4_found": TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": TERMS + "SELECT term, occurrences, records, mark FROM marked",
}

#: Splits and names as they are spelt.
SPLIT = "CASE " + " ".join(f"WHEN regexp_replace(lower(split), '[^a-z]', '', 'g') IN ({', '.join(map(repr, spelt))}) THEN '{to}'" for to, spelt in SPLIT_NAMES.items()) + " END"


def bare(value: str) -> str:
    return f"nullif(regexp_replace(lower({value}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"


#: Episodes without a list of writings: the number that counts no attempt, and the letters without the words around numbers and
#: without the name of one of the environments at either end. An unknown environment is that of the only episode with the same goal.
EPISODES = f"""
WITH rows AS (
  SELECT DISTINCT traj_no, {SPLIT} AS given, {bare('env')} AS env, coalesce({bare('goal')}, '') AS goal, trim(trajectory_id) AS id FROM trajectories WHERE traj_no IS NOT NULL
), environments AS (
  SELECT DISTINCT env AS name FROM rows WHERE env IS NOT NULL
), spaced AS (
  SELECT *, lower(regexp_replace(id, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS words, regexp_extract_all(id, '[0-9]+') AS numbers FROM rows
), lettered AS (
  SELECT *, CASE WHEN words LIKE 'run %' THEN numbers[2] ELSE numbers[1] END::bigint AS variation,
    regexp_replace(regexp_replace(regexp_replace(words, '[^a-z]+', ' ', 'g'), '\\b(attempt|try|run|of|var|v|a)\\b', '', 'g'), ' +', '', 'g') AS letters
  FROM spaced
), named AS (
  SELECT l.*, e.name, CASE WHEN e.name IS NULL THEN letters WHEN starts_with(letters, e.name) THEN substr(letters, length(e.name) + 1) ELSE left(letters, length(letters) - length(e.name)) END AS task
  FROM lettered l LEFT JOIN environments e ON starts_with(l.letters, e.name) OR ends_with(l.letters, e.name)
), parts AS (
  SELECT traj_no, given, goal, coalesce(name, env) AS env, CASE WHEN variation IS NULL OR task = '' THEN NULL ELSE task END AS task, variation FROM named
), known AS (
  SELECT task, variation, goal, min(env) AS env FROM parts WHERE task IS NOT NULL AND env IS NOT NULL GROUP BY ALL HAVING count(DISTINCT env) = 1
), keyed AS (
  SELECT p.traj_no, given, CASE WHEN p.task IS NULL THEN 'one|' || p.traj_no WHEN coalesce(p.env, k.env) IS NULL THEN concat_ws('|', 'goal', p.task, p.variation, p.goal)
    ELSE concat_ws('|', 'episode', coalesce(p.env, k.env), p.task, p.variation) END AS key
  FROM parts p LEFT JOIN known k ON p.env IS NULL AND p.task = k.task AND p.variation = k.variation AND p.goal = k.goal
)
"""
ORACLES["p1_found"] = EPISODES + "SELECT DISTINCT traj_no FROM keyed WHERE given IS NOT NULL AND key IN (SELECT key FROM keyed WHERE given IS NOT NULL GROUP BY key HAVING count(DISTINCT given) > 1)"
ORACLES["p1_together"] = EPISODES + "SELECT count(DISTINCT traj_no) AS trajectories, count(DISTINCT key) AS episodes, 0::bigint AS divided FROM keyed"

#: What every packing has to keep.
ORACLES["p7_kept"] = f"""
WITH once AS (
  SELECT traj_no, blocks FROM trajectories WHERE traj_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY traj_no ORDER BY loaded_at NULLS FIRST) = 1
), said AS (
  SELECT traj_no, unnest(blocks) AS b FROM once
), counted AS (
  SELECT traj_no, sum(len(regexp_extract_all(lower(b.text), '{WORD_SQL}'))) AS n FROM said WHERE b.type IN ('Goal', 'Think', 'Action', 'Observation') AND b.text IS NOT NULL GROUP BY traj_no
), sizes AS (
  SELECT traj_no, coalesce(n, 0) AS n FROM once LEFT JOIN counted USING (traj_no)
)
SELECT pack_name, count(*) AS trajectories, sum(n)::bigint AS tokens, sum(greatest(1, ceil(n / max_len::double)))::bigint AS pieces, count(*) FILTER (n > max_len) AS divided, 0::bigint AS above_capacity
FROM sizes, pack_sizes WHERE max_len >= 1 AND pack_name IS NOT NULL GROUP BY pack_name
"""

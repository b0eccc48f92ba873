"""Queries over recorded quantities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scriptorium.functions.lexicon import METRIC_ALIASES, UNITS
from scriptorium.operators import units
from scriptorium.sources.tables import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convertible claims with their value in the target unit of the metric's quantity."""
    return units.convert_values(read_table(spark, sf_dir, "result_claims"), read_table(spark, sf_dir, "canon_terms"))


def _sql() -> str:
    """The conversion as SQL. The dialect has no look-around: what stands beside a number or a unit is doubled first."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    key = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
    numbers = lambda c: f"array_to_string(regexp_extract_all({c}, '[0-9]+'), ' ')"
    edits = lambda n: f"CASE {' '.join(f'WHEN {n} <= {most} THEN {e}' for most, e in units.EDITS)} ELSE {units.MOST_EDITS} END"
    aliases = ", ".join(f"({quote(c)}, {quote(s)})" for c, group in METRIC_ALIASES.items() for s in group)
    factors = ", ".join(f"({quote(q)}, {quote(s)}, {float(f)!r}::DOUBLE)" for q, by in UNITS.items() for f, group in by.items() for s in group)
    spellings = sorted({s for by in UNITS.values() for group in by.values() for s in group}, key=lambda s: (-len(s), s))
    unit = "|".join(re.escape(s).replace("\\ ", " +").replace("\\-", "-+") for s in spellings)
    name = units.NAME_AND_UNIT
    said = r"(?:^|[^A-Za-z0-9_.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d*\.\d+|\d+)\s*(" + unit + r")(?:$|[^A-Za-z0-9/])"
    return f"""WITH al(canonical, said) AS (VALUES {aliases}), un(quantity, unit, factor) AS (VALUES {factors}),
en AS (SELECT canonical, quantity FROM canon_terms WHERE field = 'metric' AND quantity IS NOT NULL),
sp AS (SELECT {key("said")} AS spelling, min(quantity) AS quantity FROM (SELECT quantity, canonical AS said FROM en UNION ALL SELECT quantity, said FROM en JOIN al USING (canonical)) GROUP BY 1),
st AS (SELECT *, {numbers("spelling")} AS numbers, {edits("length(spelling)")} AS reach FROM sp WHERE spelling <> ''),
cl AS (SELECT DISTINCT claim_id, metric, value, evidence FROM result_claims WHERE value >= 0 AND NOT isnan(value)),
me AS (SELECT DISTINCT metric FROM cl WHERE metric IS NOT NULL),
rd AS (SELECT metric, 0 AS part, {key("metric")} AS k, NULL AS unit FROM me UNION ALL SELECT metric, 1, {key(f"regexp_extract(metric, {quote(name)}, 1)")},
coalesce({", ".join(f"nullif(regexp_extract(metric, {quote(name)}, {g}), '')" for g in (2, 3, 4, 5))}) FROM me),
rn AS (SELECT *, {numbers("k")} AS numbers FROM rd WHERE k <> ''),
fo AS (SELECT metric, part AS stage, 0 AS far, spelling, quantity, unit FROM rn JOIN st ON k = spelling
UNION ALL SELECT metric, CASE WHEN EXISTS (SELECT 1 FROM un WHERE un.quantity = st.quantity AND un.unit = rn.unit) THEN 2 WHEN part = 0 THEN 3 ELSE 4 END, levenshtein(k, spelling), spelling, quantity, unit
FROM rn JOIN st USING (numbers) WHERE k <> spelling AND abs(length(k) - length(spelling)) <= reach AND levenshtein(k, spelling) <= least(reach, {edits("length(k) + 2")})
UNION ALL SELECT metric, part + 5, length(spelling) - length(k), spelling, quantity, unit FROM rn JOIN st USING (numbers) WHERE left(k, 1) = left(spelling, 1) AND right(k, 1) = right(spelling, 1)
AND length(k) >= {units.CONTRACTION_LETTERS} AND length(k) < length(spelling) AND length(k) >= {units.CONTRACTION_SHARE}::DOUBLE * length(spelling)
AND regexp_matches(spelling, '^' || array_to_string(string_split(k, ''), '[a-z0-9]*') || '$')),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY stage, far, spelling, quantity, unit) AS n FROM fo) WHERE n = 1),
kn AS (SELECT claim_id, value, quantity, unit, regexp_replace(evidence, '([^A-Za-z0-9_.,/%‰µμ])', '\\1\\1', 'g') AS e FROM cl JOIN be USING (metric)),
nu AS (SELECT *, regexp_extract_all(e, {quote(said)}, 1) AS ns, regexp_extract_all(e, {quote(said)}, 2) AS us FROM kn),
ev AS (SELECT claim_id, value, quantity, unit, min_by(factor, pos) AS factor FROM (SELECT claim_id, value, quantity, unit, unnest(ns) AS n, regexp_replace(regexp_replace(unnest(us), ' +', ' ', 'g'), '-+', '-', 'g') AS u, unnest(range(len(ns))) AS pos FROM nu) x
JOIN (SELECT quantity AS q, unit AS s, factor FROM un) y ON q = quantity AND s = u WHERE abs(CAST(replace(n, ',', '') AS DOUBLE) - value) <= value * 1e-9 GROUP BY ALL),
ru AS (SELECT kn.claim_id, kn.value, coalesce(un.factor, ev.factor, CASE WHEN kn.quantity = 'score' THEN CASE WHEN kn.value <= 1 THEN 10000.0::DOUBLE ELSE 100.0::DOUBLE END END) AS factor
FROM kn LEFT JOIN un ON un.quantity = kn.quantity AND un.unit = kn.unit
LEFT JOIN ev ON ev.claim_id IS NOT DISTINCT FROM kn.claim_id AND ev.value = kn.value AND ev.quantity = kn.quantity AND ev.unit IS NOT DISTINCT FROM kn.unit)
SELECT DISTINCT claim_id, CAST(round(round(value * factor, 5)) AS BIGINT) AS target_value FROM ru WHERE factor IS NOT NULL"""


QUERIES = {"p4_found": p4_found}
ORACLE = {"p4_found": _sql()}

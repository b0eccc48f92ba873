"""SQL parts that check the registered queries: names, aliases, merges, edges, packing. Plain text for another engine."""

from __future__ import annotations

import re

from scriptorium.operators import graph, text
from scriptorium.operators.resolution import COSINE, LEAST_NAME, NOISE_WORDS, OVERLAP, SUFFIXES

#: White space and word characters as the engine's Unicode classes have them.
WS = r"[\s\v\p{Z}\x{85}]"
WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
_YEAR = r"\b(1[89]|20)\d{2}\b"
_BRACKET, _MODIFIER = rf"{WS}*\([^()]*\){WS}*$", rf"{WS}*\+{WS}*[A-Za-z0-9_-]{{1,12}}{WS}*$"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def trims(said: str) -> str:
    """SQL with each trim(...) taking off white space of any kind."""
    return re.sub(r"\btrim\(((?:[^()]|\([^()]*\))*)\)", lambda m: trim(m[1]), said)


def estimate(x: str) -> str:
    """The token estimate of a text."""
    return f"(CASE WHEN length({x}) > 0 THEN greatest(1, CAST(floor(len(list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INT)) ELSE 0 END)"


def valid(x: str) -> str:
    """A usable name."""
    return rf"(length({trim(x)}) BETWEEN 2 AND 200 AND regexp_matches({trim(x)}, '^[A-Za-z0-9]') AND regexp_matches({trim(x)}, '\p{{L}}'))"


def strips(source: str) -> str:
    """CTEs that end in sc(x, s): each string of `source` (x) without its configuration, one group a step."""
    cut, last = f"regexp_replace(s, '{_BRACKET}', '')", f"regexp_extract(s, '{_BRACKET}')"
    beneath = f"regexp_replace(s, '{_MODIFIER}', '')"
    below = f"regexp_extract({beneath}, '{_BRACKET}')"
    bracket = f"(regexp_matches(s, '{_BRACKET}') AND NOT regexp_matches({last}, '{_YEAR}'))"
    modifier = f"(regexp_matches(s, '{_MODIFIER}') AND regexp_matches({beneath}, '{_BRACKET}') AND NOT regexp_matches({below}, '{_YEAR}'))"
    step = f"CASE WHEN {bracket} THEN CASE WHEN length({trim(cut)}) >= {LEAST_NAME} THEN {trim(cut)} ELSE s END WHEN {modifier} AND length({trim(beneath)}) >= {LEAST_NAME} THEN {trim(beneath)} ELSE s END"
    return f"""sr AS (SELECT x, {trim("x")} AS s, 0 AS n FROM (SELECT DISTINCT x FROM ({source}) WHERE x IS NOT NULL)
UNION ALL SELECT x, t, n + 1 FROM (SELECT x, s, n, {step} AS t FROM sr) WHERE t <> s),
sc AS (SELECT x, arg_max(s, n) AS s FROM sr GROUP BY 1)"""


_STEM = "regexp_replace({w}, '^(.{{3,}}?)(" + "|".join(SUFFIXES) + ")$', '\\1')"
_MANY = "(CASE WHEN ends_with(w, 'es') AND NOT regexp_matches(w, '[si]es$') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)"


def normal(stripped: str) -> str:
    """The normal form of a name without its configuration."""
    spaced = f"trim(regexp_replace(regexp_replace(lower({stripped}), '[^{WORD}\\s\\v\\p{{Z}}\\x{{85}}]', ' ', 'g'), '{WS}+', ' ', 'g'))"
    noise = "|".join(sorted(NOISE_WORDS))
    plain = f"regexp_replace({spaced}, '([^ ])( ({noise}))+$', '\\1')"
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: {_STEM.format(w=_MANY)}), ' ')"


def resolved(names: str, p: str) -> str:
    """CTEs that end in {p}res(type, name, canonical): names (type, name) of `names` merged; needs sc of all of them."""
    digits = lambda x: f"list_sort(list_distinct(regexp_extract_all({x}, '[0-9]+')))"
    conflict = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND {a} <> {b})"
    hashed = "list_transform(range(64), lambda b: CAST(len(list_filter(list_transform(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: CAST('0x' || left(md5(w), 6) AS BIGINT) % 64), lambda x: x = b)) AS DOUBLE))"
    star = lambda form: f"""SELECT type, head, name FROM (SELECT *, first_value(name) OVER o AS head, first_value(digits) OVER o AS hd FROM {p}g WHERE {form} <> '' WINDOW o AS (PARTITION BY type, {form} ORDER BY length(name), name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE name <> head AND NOT {conflict("digits", "hd")}"""  # noqa: E731
    return f"""{p}g AS (SELECT type, name, norm, replace(norm, ' ', '') AS tight, list_distinct(string_split(norm, ' ')) AS words, {digits("name")} AS digits, {hashed} AS v
FROM (SELECT type, name, {normal("s")} AS norm, s FROM (SELECT DISTINCT type, name FROM ({names}) WHERE type IS NOT NULL AND name IS NOT NULL) JOIN sc ON x = name)),
{p}w AS (SELECT type, name, unnest(words) AS word FROM {p}g WHERE type <> 'Paper'),
{p}c AS (SELECT DISTINCT a.type, a.name AS a, b.name AS b FROM {p}w a JOIN {p}w b USING (type, word) WHERE a.name < b.name),
{p}s AS (SELECT c.type, c.a, c.b FROM {p}c c JOIN {p}g x ON x.type = c.type AND x.name = c.a JOIN {p}g y ON y.type = c.type AND y.name = c.b
WHERE len(list_intersect(x.words, y.words)) >= {OVERLAP}::DOUBLE * len(list_distinct(list_concat(x.words, y.words))) AND NOT {conflict("x.digits", "y.digits")} AND list_cosine_similarity(x.v, y.v) >= {COSINE}),
{p}e AS ({star("norm")} UNION {star("tight")} UNION SELECT type, a, b FROM {p}s),
{p}u AS (SELECT type, head AS a, name AS b FROM {p}e UNION SELECT type, name, head FROM {p}e),
{p}k AS (SELECT type, name AS a, name AS b FROM {p}g UNION SELECT r.type, r.a, u.b FROM {p}k r JOIN {p}u u ON u.type = r.type AND u.a = r.b),
{p}res AS (SELECT type, name, s AS canonical FROM (SELECT type, a AS name, arg_max(b, (length(b), b)) AS root FROM {p}k GROUP BY 1, 2) JOIN sc ON x = root)"""


#: All strings whose configuration is stripped in the graph.
_STRINGS = trims("""SELECT trim(name) AS x FROM entities UNION ALL SELECT trim(unnest(aliases)) FROM entities
UNION ALL SELECT trim(r.subject) FROM (SELECT unnest(relations) AS r FROM extractions) UNION ALL SELECT trim(r.object) FROM (SELECT unnest(relations) AS r FROM extractions)
UNION ALL SELECT trim(method) FROM result_claims UNION ALL SELECT trim(dataset) FROM result_claims""")
_FREQUENT = "(SELECT {k} AS k, arg_max(type, (c, type)) AS type FROM (SELECT {k}, type, count(*) AS c FROM {t} GROUP BY 1, 2) GROUP BY 1)"

#: al(key, canonical, type): names and aliases to their canonical name.
ALIASES = f"""{strips(_STRINGS)},
{trims("av AS (SELECT trim(name) AS surface, trim(name) AS name, type FROM entities UNION ALL SELECT trim(unnest(aliases)), trim(name), type FROM entities)")},
ak AS (SELECT lower(s.s) AS key, av.name, type, n.s = av.name AS plain FROM av JOIN sc s ON s.x = surface JOIN sc n ON n.x = av.name WHERE {valid("surface")} AND {valid("av.name")}),
al AS (SELECT key, canonical, type FROM (SELECT key, arg_max(name, (plain, length(name), name)) AS canonical FROM ak GROUP BY 1) JOIN {_FREQUENT.format(k="key", t="ak")} ON k = key)"""

#: ma(key, canonical, type): the aliases with their canonical names merged.
MERGED = f"""{ALIASES},
mt AS (SELECT k AS name, type FROM {_FREQUENT.format(k="canonical", t="al")}),
{resolved("SELECT type, name FROM mt", "m")},
mn AS (SELECT key, m.canonical, m.type FROM al JOIN mres m ON m.name = al.canonical),
ma AS (SELECT key, canonical, t.type FROM mn JOIN {_FREQUENT.format(k="canonical", t="mn")} t ON t.k = canonical)"""

_SIGNATURES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in graph.SIGNATURES)
#: fi: the first of equal relations with two known ends; said: those with an allowed signature; bo: all relations with their ends.
EDGES = f"""{MERGED},
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY seq DESC) AS n FROM extractions WHERE status = 'ok' AND window_id IS NOT NULL) WHERE n = 1),
re AS (SELECT seq, window_id, paper_id, unnest(relations) AS r, generate_subscripts(relations, 1) - 1 AS rel_no FROM ok),
bo AS (SELECT seq, rel_no, window_id, paper_id, r.predicate AS rel, r.confidence AS confidence, s.canonical AS sn, s.type AS sl, o.canonical AS on_, o.type AS ol FROM re
LEFT JOIN sc ss ON ss.x = {trim("r.subject")} LEFT JOIN ma s ON s.key = lower(ss.s) LEFT JOIN sc os ON os.x = {trim("r.object")} LEFT JOIN ma o ON o.key = lower(os.s)),
na AS (SELECT *, CASE WHEN sl = 'Paper' THEN paper_id ELSE sn END AS src, CASE WHEN ol = 'Paper' THEN paper_id ELSE on_ END AS dst FROM bo),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel, src, dst ORDER BY seq, rel_no, window_id) AS n FROM na WHERE rel <> '' AND src IS NOT NULL AND dst IS NOT NULL) WHERE n = 1),
said AS (SELECT rel, sl AS src_label, src, ol AS dst_label, dst, window_id, coalesce(confidence, 0.8)::DOUBLE AS confidence FROM fi JOIN (VALUES {_SIGNATURES}) g(a, b, c) ON rel = a AND sl = b AND ol = c)"""

#: nodes(label, key, aliases) and edges of the whole graph.
GRAPH = f"""{EDGES},
pa AS (SELECT paper_id AS src, dst, min(n - 1) AS ordinal FROM (SELECT paper_id, unnest(authors) AS dst, generate_subscripts(authors, 1) AS n FROM papers) WHERE dst <> '' AND paper_id IS NOT NULL GROUP BY 1, 2),
cl AS (SELECT DISTINCT * FROM result_claims),
rp AS (SELECT paper_id AS src, {trim("metric")} AS dst, window_id, left(coalesce(m.canonical, {trim("method")}, ''), {graph.PROPERTY_LENGTH}) AS method, left(coalesce(d.canonical, {trim("dataset")}, ''), {graph.PROPERTY_LENGTH}) AS dataset, coalesce(value, 0) AS value
FROM cl LEFT JOIN sc ms ON ms.x = {trim("method")} LEFT JOIN ma m ON m.key = lower(ms.s) LEFT JOIN sc ds ON ds.x = {trim("dataset")} LEFT JOIN ma d ON d.key = lower(ds.s) WHERE {trim("metric")} <> '' AND paper_id IS NOT NULL),
en AS (SELECT type AS label, canonical AS key, array_to_string(list_sort(list_distinct(list(ma.key))), ', ') AS aliases FROM ma WHERE type IN ({", ".join(f"'{t}'" for t in graph.EXTRACTABLE)}) GROUP BY 1, 2),
nodes AS (SELECT label, key, max(aliases) AS aliases FROM (SELECT label, key, aliases FROM en UNION ALL SELECT DISTINCT 'Paper', paper_id, NULL FROM papers UNION ALL SELECT 'Author', dst, NULL FROM pa UNION ALL SELECT 'Metric', dst, NULL FROM rp) WHERE key IS NOT NULL GROUP BY 1, 2),
ae AS (SELECT 'AUTHORED_BY' AS rel, 'Paper' AS src_label, src, 'Author' AS dst_label, dst, NULL AS window_id, 1.0::DOUBLE AS confidence FROM pa UNION ALL SELECT rel, src_label, src, dst_label, dst, window_id, confidence FROM said
UNION ALL SELECT 'REPORTS', 'Paper', src, 'Metric', dst, window_id, 1.0 FROM rp),
edges AS (SELECT * FROM ae WHERE EXISTS (SELECT 1 FROM nodes WHERE label = src_label AND key = src) AND EXISTS (SELECT 1 FROM nodes WHERE label = dst_label AND key = dst))"""

WEIGHTS = GRAPH + f""", w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(coalesce(nullif(confidence, 0), 1.0)) AS weight
FROM edges WHERE rel IN ({", ".join(f"'{r}'" for r in graph.THEMATIC)}) AND src_label <> 'Paper' AND dst_label <> 'Paper' AND src <> dst GROUP BY 1, 2)"""


def sections(source: str) -> str:
    """CTEs that end in se(id, ordinal, title, char_start, char_end) of texts (id, text) in `source`."""
    bare = ", ".join(f"'{h}'" for h in text.BARE_HEADINGS)
    numbered = text.NUMBERED_HEADING.replace("'", "''")
    return rf"""sl AS (SELECT id, text, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM ({source})),
so AS (SELECT *, CAST(sum(length(said) + 1) OVER (PARTITION BY id ORDER BY line) - length(said) - 1 AS INT) AS pos, trim(said) AS t FROM sl),
sh AS (SELECT *, CASE WHEN length(t) BETWEEN 1 AND 80 THEN CASE WHEN lower(regexp_replace(t, '[.:]+$', '')) IN ({bare})
THEN array_to_string(list_transform(string_split(lower(regexp_replace(t, '[.:]+$', '')), ' '), lambda x: upper(x[1])||x[2:]), ' ')
ELSE nullif(regexp_replace(trim(regexp_extract(t, '{numbered}', 2)), '[.:]+$', ''), '') END END AS title FROM so),
sk AS (SELECT *, count(title) OVER (PARTITION BY id) AS heads FROM sh),
sm AS (SELECT * FROM sk WHERE line = 0 OR title IS NOT NULL),
se AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY line) - 1 AS INT) AS ordinal,
coalesce(title, CASE WHEN heads = 0 THEN 'Body' ELSE 'Front Matter' END) AS title, pos AS char_start,
CAST(coalesce(lead(pos) OVER (PARTITION BY id ORDER BY line), length(text)) AS INT) AS char_end FROM sm)"""


def packed(source: str, target: int, overlap: int, windows: bool) -> str:
    """CTEs that end in pk(id, char_start, char_end, said): the pieces of texts (id, text) in `source`, by recursion."""
    gap = r"\n\s*\n"
    skipped = ", ".join(f"'{t}'" for t in text.NON_EXTRACTIVE)
    run = f"""pr AS (SELECT p.id, p.p, p.a, (SELECT count(*) FROM se s WHERE s.id = p.id AND lower(trim(s.title)) IN ({skipped}) AND s.char_start < h.char_start) AS run
FROM pq p JOIN se h ON h.id = p.id AND h.char_start <= p.a AND p.a + length(p.p) <= h.char_end WHERE lower(trim(h.title)) NOT IN ({skipped}))"""
    return rf"""{sections(source)},
pd AS (SELECT id, text, string_split_regex(text, '{gap}') AS ps, regexp_extract_all(text, '{gap}') AS ss FROM ({source})),
pi AS (SELECT id, ps, ss, unnest(range(1, len(ps) + 1)) AS i FROM pd),
pq AS (SELECT id, ps[i] AS p, CAST(coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ss[1:i - 1], lambda x: length(x))), 0) AS INT) AS a FROM pi WHERE NOT regexp_matches(ps[i], '^{WS}*$')),
{run if windows else "pr AS (SELECT *, 0 AS run FROM pq)"},
ps AS (SELECT id, run, a AS base, p, string_split(regexp_replace(p, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM pr WHERE {estimate("p")} > {target}),
px AS (SELECT id, run, base, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, parts FROM ps),
py AS (SELECT id, run, base, i, {estimate("part")} AS cost, CAST(base + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS INT) AS a, length(part) AS size FROM px),
pg AS (SELECT id, run, base, i, a AS opened, cost AS budget, a + size AS b FROM py WHERE i = 1
UNION ALL SELECT y.id, y.run, y.base, y.i, CASE WHEN g.budget > 0 AND g.budget + y.cost > {target} THEN y.a ELSE g.opened END, CASE WHEN g.budget > 0 AND g.budget + y.cost > {target} THEN y.cost ELSE g.budget + y.cost END, y.a + y.size
FROM pg g JOIN py y ON y.id = g.id AND y.run = g.run AND y.base = g.base AND y.i = g.i + 1),
pa_ AS (SELECT id, run, opened AS a, CAST(max(b) AS INT) AS b FROM pg GROUP BY 1, 2, 3 HAVING max(b) > opened UNION ALL SELECT id, run, a, a + length(p) FROM pr WHERE {estimate("p")} <= {target}),
pc AS (SELECT x.id, run, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, list({estimate("substring(text, a + 1, b - a)")} ORDER BY a) AS costs FROM pa_ x JOIN pd ON pd.id = x.id GROUP BY 1, 2),
pe AS (SELECT *, list_transform(range(1, len(costs) + 1), lambda i: CAST(list_sum(costs[1:i]) AS INT)) AS sums FROM pc),
pu AS (SELECT id, run, 1 AS f, 1 AS n, greatest(1, len(list_filter(sums, lambda x: x <= {target}))) AS e FROM pe
UNION ALL SELECT id, run, f, n, greatest(n, len(list_filter(sums, lambda x: x <= CASE WHEN f > 1 THEN sums[f - 1] ELSE 0 END + {target}))) FROM (
SELECT pu.id, pu.run, sums, greatest(pu.f, 1 + CASE WHEN sums[pu.e] - {overlap} > 0 THEN 1 ELSE 0 END + len(list_filter(sums, lambda x: x < sums[pu.e] - {overlap}))) AS f, pu.e + 1 AS n FROM pu JOIN pe USING (id, run) WHERE pu.e < len(sums))),
pk AS (SELECT pu.id, starts[f] AS char_start, ends[e] AS char_end, substring(text, starts[f] + 1, ends[e] - starts[f]) AS said FROM pu JOIN pe USING (id, run) JOIN pd ON pd.id = pu.id)"""

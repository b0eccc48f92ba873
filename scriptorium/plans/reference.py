"""Registered queries of the engine's own operators, each over whole tables, with the SQL to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.tokens import bind, lexical_tokens, span_id, strip, token_estimate
from scriptorium.operators import answering, backend, chunking, communities, evaluation, extraction, graph, resolution, retrieval, text
from scriptorium.operators.components import connected_components
from scriptorium.operators.match import Graph
from scriptorium.plans import sql
from scriptorium.sources.records import pending
from scriptorium.sources.tables import durable, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_WS = sql.WS


def query(text: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if text:
            ORACLE[fn.__name__] = text
        return fn

    return add


@query("""SELECT doc_id, CAST(coalesce(len(t), 0) AS BIGINT) AS n_tokens, CAST(coalesce(len(list_distinct(t)), 0) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)""")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and distinct tokens of every document; null texts have none."""
    both = bind(lexical_tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("u")))
    rows = read_table(spark, d, "documents").select("doc_id", both.alias("b"))
    zero = lambda c: F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0)).cast("bigint")
    return rows.select("doc_id", zero("b.n").alias("n_tokens"), zero("b.u").alias("n_distinct"))


@query(rf"""SELECT DISTINCT chunk_id, CAST(CASE WHEN length(text) > 0 THEN greatest(1, CAST(floor(len(list_filter(
string_split_regex(text, '{_WS}+'), lambda x: x <> '')) * 1.3::DOUBLE) AS INT)) ELSE 0 END AS INT) AS estimate FROM chunks""")
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The estimate of every chunk, recomputed from its text."""
    return read_table(spark, d, "chunks").select("chunk_id", token_estimate(F.col("text")).alias("estimate")).distinct()


@query(rf"""WITH a AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'),
chr(160), ' ') AS x FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(x, '([\p{{L}}\p{{N}}\p{{M}}_])-\n([\p{{L}}\p{{N}}\p{{M}}_])', '\1\2', 'g') AS x FROM a),
c AS (SELECT doc_id, replace(regexp_replace(replace(replace(x, chr(10)||chr(10), chr(2)||chr(2)), chr(2)||chr(10), chr(2)||chr(2)),
'(^|[^.?!:;'||chr(2)||'])\n', '\1 ', 'g'), chr(2), chr(10)) AS x FROM b),
e AS (SELECT doc_id, regexp_replace(regexp_replace(x, '\n{{3,}}', chr(10)||chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS x FROM c)
SELECT doc_id, md5(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')) AS digest FROM e""")
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every cleaned document."""
    return read_table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


_WINDOW_TEXTS = "SELECT DISTINCT window_id AS id, text FROM windows WHERE text IS NOT NULL"


@query(f"WITH {sql.sections(_WINDOW_TEXTS)} SELECT id AS window_id, ordinal, title, char_start, char_end FROM se")
def detect_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings and section spans of every window's text."""
    return text.detect_sections(read_table(spark, d, "windows").select("window_id", "text").distinct(), "window_id")


#: Chunks as pages that seven of eight times carry a running head, and always a page number as their last line.
_PAGES = """SELECT paper_id, chunk_id, CASE WHEN ascii(chunk_id) % 8 <> 0 THEN 'Proceedings, paper ' || paper_id || chr(10) ELSE '' END || text || chr(10) || char_start AS text
FROM (SELECT DISTINCT paper_id, chunk_id, char_start, text FROM chunks WHERE text IS NOT NULL AND paper_id IS NOT NULL)"""
_REPEATED = f"""l AS (SELECT paper_id, chunk_id, trim(unnest(string_split(text, chr(10)))) AS line FROM ({_PAGES})),
s AS (SELECT paper_id, count(DISTINCT chunk_id) AS total FROM ({_PAGES}) GROUP BY 1 HAVING count(DISTINCT chunk_id) >= 4),
g AS (SELECT paper_id, line, count(DISTINCT chunk_id) AS pages FROM l WHERE length(line) > 0 GROUP BY 1, 2),
r AS (SELECT paper_id, line, CAST(pages AS BIGINT) AS pages FROM g JOIN s USING (paper_id) WHERE pages >= greatest(2, floor(0.6::DOUBLE * total)) AND length(line) < 120 AND NOT ends_with(line, '.'))"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "chunks").select("paper_id", "chunk_id", "char_start", "text").filter("text is not null and paper_id is not null").distinct()
    head = F.when(F.ascii("chunk_id") % 8 != 0, F.concat(F.lit("Proceedings, paper "), "paper_id", F.lit("\n"))).otherwise("")
    return rows.select("paper_id", "chunk_id", F.concat(head, "text", F.lit("\n"), F.col("char_start").cast("string")).alias("text"))


@query(f"WITH {_REPEATED} SELECT * FROM r")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Running heads of papers whose chunks stand for pages, at the default share."""
    return text.repeated_lines(_pages(spark, d), "paper_id", "chunk_id", "text")


@query(f"""WITH {_REPEATED}, k AS (SELECT paper_id, chunk_id, text, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({_PAGES})),
o AS (SELECT paper_id, chunk_id, text, string_agg(said, chr(10) ORDER BY n) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.paper_id = k.paper_id AND r.line = trim(said))) AS kept FROM k GROUP BY 1, 2, 3)
SELECT chunk_id, md5(coalesce(kept, '')) AS digest FROM o""")
def stripped_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages without their running heads."""
    rows = _pages(spark, d).withColumn("page", F.struct("chunk_id", F.md5("text").alias("h")))
    return text.strip_repeated_lines(rows, "paper_id", "page", "text").select("page.chunk_id", F.md5("text").alias("digest"))


@query("""WITH b AS (SELECT doc_id // 8 AS page, (doc_id * 37) % 600 AS x0, (doc_id * 37) % 600 + (doc_id * 53) % 480 + 20 AS x1, (doc_id * 29) % 800 AS y0, trim(text) AS text FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0),
s AS (SELECT *, CASE WHEN (x1 - x0) / 600.0 > 0.6 THEN 'full' WHEN (x0 + x1) / 2.0 < 300 THEN 'left' ELSE 'right' END AS side FROM b),
p AS (SELECT *, count(*) FILTER (side = 'left') OVER w AS lefts, count(*) FILTER (side = 'right') OVER w AS rights, min(y0) FILTER (side <> 'full') OVER w AS top FROM s WINDOW w AS (PARTITION BY page)),
o AS (SELECT *, CASE WHEN lefts = 0 OR rights = 0 THEN 0 WHEN side = 'left' THEN 1 WHEN side = 'right' THEN 2 WHEN y0 < top THEN 0 ELSE 3 END AS band FROM p)
SELECT page, md5(string_agg(text, chr(10) ORDER BY band, y0, text)) AS digest FROM o GROUP BY 1""")
def page_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the blocks of pages of eight, every fifth being a picture, in reading order."""
    n = F.col("doc_id")
    blocks = read_table(spark, d, "documents").filter("text is not null").select(
        F.floor(n / 8).alias("page"), F.lit(600.0).alias("width"), (n * 37 % 600).cast("double").alias("x0"), (n * 37 % 600 + n * 53 % 480 + 20).cast("double").alias("x1"),
        (n * 29 % 800).cast("double").alias("y0"), "text", F.when(n % 5 == 0, 1).otherwise(0).alias("block_type"),
    )
    return text.reading_order(blocks, "page", "width").select("page", F.md5("text").alias("digest"))


@query("""SELECT DISTINCT paper_id, char_start, char_end, left(sha1(concat_ws(':', paper_id, char_start, char_end)), 16) AS id,
left(sha1(concat_ws(':', paper_id, char_start, char_end)), 16) = chunk_id AS same FROM chunks""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all chunks from their offsets."""
    made = span_id(F.col("paper_id"), F.col("char_start"), F.col("char_end"))
    return read_table(spark, d, "chunks").select("paper_id", "char_start", "char_end", made.alias("id"), (made == F.col("chunk_id")).alias("same")).distinct()


_DOCUMENT_TEXTS = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE text IS NOT NULL"
_CHUNK = "left(sha1(concat_ws(':', pk.id, char_start, char_end)), 16) AS chunk_id, pk.id AS paper_id, md5(said) AS digest, char_start, char_end"
_CHUNKS_SQL = """WITH RECURSIVE {pack} SELECT DISTINCT {chunk}, coalesce((SELECT min(title) FROM se WHERE se.id = pk.id AND se.char_start <= pk.char_start AND pk.char_start < se.char_end), '') AS section, CAST({estimate} AS INT) AS token_estimate FROM pk"""


def _told(chunks: DataFrame, *last: str) -> DataFrame:
    """Pieces with a digest of their text, repeated ones once: texts themselves are not shuffled."""
    return chunks.withColumn("digest", F.md5("text")).select(chunks.columns[0], "paper_id", "digest", "char_start", "char_end", *last, "token_estimate").distinct()


@query(_CHUNKS_SQL.format(pack=sql.packed(_DOCUMENT_TEXTS, 800, 100, False), chunk=_CHUNK, estimate=sql.estimate("said")))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval chunks of every document at the default size."""
    return _told(chunking.build_chunks(read_table(spark, d, "documents"), "doc_id"), "section")


@query(_CHUNKS_SQL.format(pack=sql.packed(_WINDOW_TEXTS, 800, 100, False), chunk=_CHUNK, estimate=sql.estimate("said")))
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval chunks of every window's text, which is longer than a chunk, at the default size."""
    return _told(chunking.build_chunks(read_table(spark, d, "windows"), "window_id"), "section")


@query(f"""WITH RECURSIVE {sql.packed(_WINDOW_TEXTS, 4000, 200, True)} SELECT DISTINCT left(sha1(concat_ws(':', 'win', pk.id, char_start, char_end)), 16) AS window_id, pk.id AS paper_id, md5(said) AS digest, char_start, char_end,
(SELECT list_sort(list_distinct(list(title))) FROM se WHERE se.id = pk.id AND se.char_start < pk.char_end AND se.char_end > pk.char_start) AS sections, CAST({sql.estimate("said")} AS INT) AS token_estimate FROM pk""")
def extraction_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extraction windows of every window's text at the default size, without what may not be extracted."""
    return _told(chunking.build_windows(read_table(spark, d, "windows"), "window_id"), "sections")


@query("""SELECT (SELECT count(DISTINCT paper_id) FROM papers) AS papers, (SELECT count(DISTINCT chunk_id) FROM chunks) AS chunks,
(SELECT count(DISTINCT window_id) FROM windows) AS windows, (SELECT count(*) FROM embeddings) AS vectors""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the corpus."""
    n = lambda t, c, name: read_table(spark, d, t).agg(F.count_distinct(c).alias(name))
    out = n("papers", "paper_id", "papers").crossJoin(n("chunks", "chunk_id", "chunks")).crossJoin(n("windows", "window_id", "windows"))
    return out.crossJoin(read_table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors")))


@query(rf"""WITH w AS (SELECT DISTINCT window_id, text FROM windows), e AS (SELECT CASE WHEN length(text) > 0 THEN greatest(1, CAST(floor(len(list_filter(
string_split_regex(text, '{_WS}+'), lambda x: x <> '')) * 1.3::DOUBLE) AS INT)) ELSE 0 END AS n FROM w)
SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS input, CAST(floor(0.6::DOUBLE * sum(n)) AS BIGINT) AS output,
CAST(sum(n) + floor(0.6::DOUBLE * sum(n)) AS BIGINT) AS total FROM e""")
def dry_run(spark: SparkSession, d: str) -> DataFrame:
    """C17: what an extraction of all windows would take."""
    w = read_table(spark, d, "windows").select("window_id", "text").distinct().select(token_estimate(F.col("text")).alias("n"))
    total = w.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").cast("bigint").alias("input"))
    out = total.withColumn("output", F.floor(F.col("input") * 0.6).cast("bigint"))
    return out.withColumn("total", F.col("input") + F.col("output"))


def _bm25_sql(column: str, k: int, docs: str = "documents") -> str:
    return f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {docs} WHERE text IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1),
n AS (SELECT count(*) AS total FROM {docs}), a AS (SELECT sum(len)::DOUBLE / (SELECT total FROM n) AS avgdl FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), r AS (SELECT term, df, ln(total - df + 0.5) - ln(df + 0.5) AS raw FROM f, n),
s AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT id, term, count(*) AS times FROM (SELECT id, unnest(regexp_extract_all(lower({column}), '[a-z0-9]+')) AS term FROM gold) GROUP BY 1, 2),
h AS (SELECT id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 6) AS score
FROM q JOIN p USING (term) JOIN s USING (term) JOIN l USING (doc_id), a GROUP BY 1, 2),
k AS (SELECT id, doc_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= {k})"""


@query(_bm25_sql("question", 8) + " SELECT id, doc_id, score, CAST(rank AS INT) AS rank FROM k WHERE score > 0")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The eight best documents of every question."""
    return retrieval.bm25_search(read_table(spark, d, "gold"), "id", "question", read_table(spark, d, "documents"), "doc_id", "text")


@query(_bm25_sql("question", 8) + " SELECT term, df, round(idf, 6) AS idf FROM s")
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term."""
    index = retrieval.build_index(read_table(spark, d, "documents"), "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


_VECTORS = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, e.label = q.label AS hit, round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 0), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 8)"""


def _vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_search(asked, "query_id", "embedding", rows, "vec_id", "embedding")


@query(_VECTORS + " SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM k")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine top eight of every hundredth vector against all vectors."""
    return _vector_topk(spark, d)


@query(_VECTORS + """, n AS (SELECT q.vec_id AS query_id, count(*) AS n_rel FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 100 = 0 GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (hit) AS hits, count(*) AS shown, min(rank) FILTER (hit) AS first, sum(1 / log2(rank + 1)) FILTER (hit) AS dcg FROM k GROUP BY 1)
SELECT query_id, round(hits / n_rel::DOUBLE, 4) AS recall, round(hits / shown::DOUBLE, 4) AS precision, round(coalesce(1.0 / first, 0)::DOUBLE, 4) AS mrr,
round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, 8) + 1) t(i)), 0), 4) AS ndcg FROM g JOIN n USING (query_id)""")
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG of the vector search, equal labels being relevant."""
    rows = read_table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(rows.select("label", "vec_id"), "label").select("query_id", "vec_id")
    return retrieval.retrieval_metrics(_vector_topk(spark, d), relevant, "query_id", "vec_id")


@query(_bm25_sql("question", 20) + ", k2 AS (" + _bm25_sql("reference", 20) + """ SELECT id, doc_id, rank FROM k WHERE score > 0),
u AS (SELECT id, doc_id, rank, 'question' AS source, 0 AS list FROM k WHERE score > 0 UNION ALL SELECT id, doc_id, rank, 'reference', 1 FROM k2),
g AS (SELECT id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS source, min(list * 1000 + rank) AS first FROM u GROUP BY 1, 2)
SELECT id, doc_id, score, source, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, first, doc_id) AS INT) AS rank FROM g QUALIFY rank <= 8""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The rankings of questions and of their references fused."""
    gold, docs = read_table(spark, d, "gold"), read_table(spark, d, "documents")
    index = retrieval.build_index(docs, "doc_id", "text")
    lists = [(c, retrieval.search_index(gold, "id", c, index, "doc_id", 20)) for c in ("question", "reference")]
    return retrieval.fuse(lists, "id", "doc_id", 8)


_HASHED = """(SELECT {key}, list_transform(range(64), lambda b: CAST(len(list_filter(h, lambda x: x = b)) AS DOUBLE)) AS v
FROM (SELECT {key}, list_transform(coalesce(regexp_extract_all(lower({text}), '[a-z0-9]+'), []), lambda w: CAST('0x' || left(md5(w), 6) AS BIGINT) % 64) AS h FROM {table}))"""


@query(_bm25_sql("question", 20) + f""", dv AS {_HASHED.format(key="doc_id", text="text", table="documents")}, qv AS {_HASHED.format(key="id", text="question", table="gold")},
vs AS (SELECT id, doc_id, round(coalesce(CASE WHEN isnan(list_cosine_similarity(qv.v, dv.v)) THEN 0 ELSE list_cosine_similarity(qv.v, dv.v) END, 0), 6) AS score FROM qv, dv),
vk AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 20),
u AS (SELECT id, doc_id, rank, 'vector' AS source, 0 AS list FROM vk UNION ALL SELECT id, doc_id, rank, 'bm25', 1 FROM k WHERE score > 0),
g AS (SELECT id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(DISTINCT source, '+' ORDER BY source) AS source, min(list * 1000 + rank) AS first FROM u GROUP BY 1, 2)
SELECT id, doc_id, score, source, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, first, doc_id) AS INT) AS rank FROM g QUALIFY rank <= 8""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and vector ranking of all documents for every question, fused."""
    return retrieval.hybrid_search(read_table(spark, d, "gold"), "id", "question", read_table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT DISTINCT name, list_sort(list_distinct(regexp_extract_all(name, '[0-9]+'))) AS numbers FROM entities WHERE name IS NOT NULL""")
def digit_sets(spark: SparkSession, d: str) -> DataFrame:
    """the numbers of every entity name."""
    return read_table(spark, d, "entities").filter("name is not null").select("name", resolution.numbers(F.col("name")).alias("numbers")).distinct()


@query(f"SELECT type, count(DISTINCT name) AS names, count(DISTINCT name) FILTER ({sql.valid('name')}) AS valid FROM entities GROUP BY 1")
def valid_names(spark: SparkSession, d: str) -> DataFrame:
    """Names and usable names of each type."""
    return read_table(spark, d, "entities").groupBy("type").agg(F.count_distinct("name").alias("names"), F.count_distinct(F.when(resolution.valid_name(F.col("name")), F.col("name"))).alias("valid"))


_NAMES = f"SELECT type, {sql.trim('name')} AS name FROM entities WHERE {sql.valid('name')}"


@query(f"""WITH RECURSIVE {sql.strips(f"SELECT {sql.trim('name')} AS x FROM entities")}, {sql.resolved(_NAMES, "m")} SELECT type, name, canonical FROM mres""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """F1-F8: canonical name of every entity name of every type."""
    names = read_table(spark, d, "entities").filter(resolution.valid_name(F.col("name")))
    return resolution.resolve_entities(names.select("type", strip(F.col("name")).alias("name")))


@query(f"WITH RECURSIVE {sql.ALIASES} SELECT key, canonical, type FROM al")
def alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    """canonical name and type of every alias."""
    return resolution.alias_map(read_table(spark, d, "entities"))


@query("""WITH o AS (SELECT DISTINCT seq, window_id, paper_id, status FROM extractions WHERE status = 'ok' AND window_id IS NOT NULL)
SELECT window_id, max(seq) AS seq FROM o GROUP BY 1""")
def extraction_done(spark: SparkSession, d: str) -> DataFrame:
    """The accepted record of every finished window."""
    return extraction.done_windows(read_table(spark, d, "extractions")).select("window_id", "seq")


@query("""SELECT DISTINCT window_id, paper_id FROM windows w WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE e.status = 'ok' AND e.window_id = w.window_id)""")
def pending_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that still have to be extracted."""
    done = extraction.done_windows(read_table(spark, d, "extractions"))
    return pending(read_table(spark, d, "windows").select("window_id", "paper_id").distinct(), done, "window_id")


@query("""SELECT status, count(*) AS records, count(error) AS errors FROM (SELECT DISTINCT seq, window_id, status, error FROM extractions) GROUP BY 1""")
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records of each status."""
    log = read_table(spark, d, "extractions").select("seq", "window_id", "status", "error").distinct()
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.count("error").alias("errors"))


@query(f"WITH RECURSIVE {sql.strips(_NAMES.replace('SELECT type, ', 'SELECT ').replace(' AS name ', ' AS x '))} SELECT x AS name, s AS plain, {sql.normal('s')} AS normal FROM sc")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every usable name without its configuration, and its normal form."""
    names = read_table(spark, d, "entities").filter(resolution.valid_name(F.col("name"))).select(strip(F.col("name")).alias("name")).distinct()
    return names.select("name", resolution.strip_config(F.col("name")).alias("plain"), resolution.normal_form(F.col("name")).alias("normal"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of all tables: every end resolved through names, aliases, configuration and merges."""
    log, claims = extraction.done_windows(read_table(spark, d, "extractions")), read_table(spark, d, "result_claims").distinct()
    return graph.build_graph(read_table(spark, d, "papers"), log, read_table(spark, d, "entities"), claims)


_EDGES = f"WITH RECURSIVE {sql.GRAPH}"
_EDGE_COLUMNS = ["rel", "src_label", "src", "dst_label", "dst"]


@query(f"WITH RECURSIVE {sql.MERGED} SELECT key, canonical, type FROM ma")
def merged_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Every alias with its merged canonical name and type."""
    return resolution.merged_aliases(read_table(spark, d, "entities")).select("key", "canonical", "type")


@query(_EDGES + " SELECT rel, src_label, src, dst_label, dst, window_id, confidence FROM edges WHERE rel NOT IN ('AUTHORED_BY', 'REPORTS')")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations between resolved ends, the first of equal ones."""
    return _graph(spark, d)[1].filter("rel not in ('AUTHORED_BY', 'REPORTS')").select(*_EDGE_COLUMNS, "window_id", "confidence")


@query(_EDGES + " SELECT src, dst, window_id, method, dataset, CASE WHEN isnan(value) THEN NULL ELSE round(value, 6) END AS value FROM rp WHERE src IN (SELECT key FROM nodes WHERE label = 'Paper')")
def reports_edges(spark: SparkSession, d: str) -> DataFrame:
    """Reported results, methods and datasets resolved leniently."""
    rows = _graph(spark, d)[1].filter("rel = 'REPORTS'")
    return rows.select("src", "dst", "window_id", "method", "dataset", F.when(~F.isnan("value"), F.round("value", 6)).alias("value"))


@query(_EDGES + " SELECT label, key, aliases FROM nodes WHERE label <> 'Paper'")
def entity_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Named nodes with all keys that lead to them."""
    return _graph(spark, d)[0].filter("label <> 'Paper'").select("label", "key", "aliases")


@query(_EDGES + " SELECT label AS name, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT '-[:' || rel || ']->', count(*) FROM edges GROUP BY 1")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each label and edges of each relation."""
    nodes, edges, _ = _graph(spark, d)
    return graph.counts(nodes, edges)


@query(_EDGES + """ SELECT (SELECT count(*) FROM en) AS canonical_entities, (SELECT count(*) FROM edges WHERE rel <> 'AUTHORED_BY') AS relations_written,
(SELECT count(*) FROM bo WHERE coalesce(rel, '') = '' OR sn IS NULL OR on_ IS NULL) + (SELECT count(*) FROM fi) + (SELECT count(*) FROM cl) - (SELECT count(*) FROM edges WHERE rel <> 'AUTHORED_BY') AS relations_dropped""")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a build wrote and dropped."""
    return _graph(spark, d)[2]


@query("""WITH r AS (SELECT paper_id AS id, arg_max(title, ingested_at) FILTER (title IS NOT NULL) AS title, arg_max(abstract, ingested_at) FILTER (abstract IS NOT NULL) AS abstract,
arg_max(categories, ingested_at) FILTER (categories IS NOT NULL) AS categories FROM papers GROUP BY 1)
SELECT id, title, md5(left(abstract, 4000)) AS abstract, array_to_string(categories, ', ') AS categories FROM r""")
def paper_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Paper nodes, properties of the latest load that has them."""
    return graph.paper_nodes(read_table(spark, d, "papers")).withColumn("abstract", F.md5("abstract"))


@query("""SELECT DISTINCT paper_id AS src, dst, CAST(n - 1 AS INT) AS ordinal FROM (SELECT paper_id, unnest(authors) AS dst, generate_subscripts(authors, 1) AS n FROM papers) WHERE dst IS NOT NULL""")
def authored_by(spark: SparkSession, d: str) -> DataFrame:
    """Authors of every paper in their order."""
    return graph.authored_by(read_table(spark, d, "papers")).select("src", "dst", "ordinal")


@query(_EDGES + """, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
o AS (SELECT src AS source, dst AS target FROM b WHERE contains(lower(src), 'index'))
SELECT source, target FROM o UNION SELECT o.source, b.dst FROM o JOIN b ON b.src = o.target WHERE b.dst <> o.source""")
def two_hops(spark: SparkSession, d: str) -> DataFrame:
    """Everything within two hops of the nodes that are named an index."""
    return graph.neighbourhood(_graph(spark, d)[1], "index", 2)


def _ask(spark: SparkSession, d: str, text: str, **parameters: object) -> DataFrame:
    nodes, edges, _ = _graph(spark, d)
    return Graph(durable(edges.drop("evidence")), nodes).query(text, **parameters)


@query(_EDGES + """ SELECT d.dst AS dataset, count(DISTINCT d.src) AS methods FROM edges d WHERE d.rel = 'EVALUATES_ON' AND d.src_label = 'Method' AND d.dst_label = 'Dataset' GROUP BY 1 ORDER BY methods DESC, dataset LIMIT 20""")
def methods_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A guarded graph query with a distinct count; the limit is part of the report."""
    return _ask(spark, d, "MATCH (m:Method)-[:EVALUATES_ON]->(d:Dataset) RETURN d.name AS dataset, count(DISTINCT m.name) AS methods ORDER BY methods DESC, dataset LIMIT 20")


@query(_EDGES + " SELECT (SELECT count(*) FROM nodes WHERE label = 'Method') AS methods")
def count_methods(spark: SparkSession, d: str) -> DataFrame:
    """A label scan with a count."""
    return _ask(spark, d, "MATCH (m:Method) RETURN count(m) AS methods")


@query(_EDGES + """, m AS (SELECT DISTINCT src, src_label FROM edges WHERE rel = 'EVALUATES_ON' AND src_label = 'Method'), o AS (SELECT src, dst FROM edges WHERE rel = 'BUILDS_ON' AND contains(lower(dst), 'a'))
SELECT count(*) AS n, count(DISTINCT m.src) AS methods, count(DISTINCT o.dst) AS bases FROM m LEFT JOIN o ON o.src = m.src""")
def optional_bases(spark: SparkSession, d: str) -> DataFrame:
    """An optional pattern whose condition keeps the methods without a match."""
    return _ask(spark, d, "MATCH (m:Method)-[:EVALUATES_ON]->() WITH DISTINCT m OPTIONAL MATCH (m)-[:BUILDS_ON]->(b) WHERE toLower(b.name) CONTAINS 'a' RETURN count(*) AS n, count(DISTINCT m) AS methods, count(DISTINCT b) AS bases")


@query(_EDGES + """, b AS (SELECT src_label AS xl, src AS x, dst_label AS yl, dst AS y FROM edges UNION SELECT dst_label, dst, src_label, src FROM edges),
s AS (SELECT key FROM nodes WHERE label = 'Dataset' AND contains(aliases, 'harbor')),
o AS (SELECT s.key, b.yl, b.y FROM s JOIN b ON b.xl = 'Dataset' AND b.x = s.key), t AS (SELECT key, yl, y FROM o UNION SELECT o.key, b.yl, b.y FROM o JOIN b ON b.xl = o.yl AND b.x = o.y)
SELECT count(DISTINCT y) AS methods FROM t WHERE yl = 'Method'""")
def methods_within_two(spark: SparkSession, d: str) -> DataFrame:
    """An undirected path of one or two relations from the datasets with an alias, by a parameter."""
    return _ask(spark, d, "MATCH (d:Dataset)-[*1..2]-(m:Method) WHERE d.aliases CONTAINS $name RETURN count(DISTINCT m.name) AS methods", name="harbor")


_WEIGHTS = f"WITH RECURSIVE {sql.WEIGHTS}"


def _weights(edges: DataFrame) -> DataFrame:
    thematic = edges.filter(F.col("rel").isin(graph.THEMATIC) & (F.col("src_label") != "Paper") & (F.col("dst_label") != "Paper"))
    return graph.edge_weights(thematic, "src", "dst", "confidence")


@query(_WEIGHTS + " SELECT a, b, round(weight, 6) AS weight FROM w")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    """Undirected weights of the thematic edges between named nodes."""
    return _weights(_graph(spark, d)[1]).select("a", "b", F.round("weight", 6).alias("weight"))


@query(_WEIGHTS + """, h AS (SELECT * FROM w WHERE weight > 1), u AS (SELECT a, b FROM h UNION SELECT b, a FROM h), c AS (SELECT a AS n, a AS r FROM u UNION SELECT c.n, u.b FROM c JOIN u ON u.a = c.r),
l AS (SELECT n, min(r) AS c FROM c GROUP BY 1), nd AS (SELECT a AS n FROM w UNION SELECT b FROM w), p AS (SELECT nd.n, coalesce(c, nd.n) AS c FROM nd LEFT JOIN l USING (n)), t AS (SELECT sum(weight) AS m FROM w),
g AS (SELECT c, weight FROM w JOIN p ON n = a UNION ALL SELECT c, weight FROM w JOIN p ON n = b), dg AS (SELECT c, sum(weight) AS deg FROM g GROUP BY 1),
i AS (SELECT x.c, sum(weight) AS w_in FROM w JOIN p x ON x.n = a JOIN p y ON y.n = b WHERE x.c = y.c GROUP BY 1)
SELECT round(sum(coalesce(w_in, 0) / m - pow(deg / (2 * m), 2)), 6) AS modularity FROM dg LEFT JOIN i USING (c), t""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the thematic graph in the components of its heavier edges."""
    w = durable(_weights(_graph(spark, d)[1]))
    heavy = connected_components(w.filter("weight > 1"))
    nodes = w.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(heavy, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
    return graph.modularity(w, nodes).select(F.round("modularity", 6).alias("modularity"))


@query()
def community_members(spark: SparkSession, d: str) -> DataFrame:
    """H2: Leiden communities of the thematic graph, its ends resolved through aliases and merges."""
    return communities.detect_communities(_weights(_graph(spark, d)[1]))


@query()
def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    """H2, H7: modularity of the found communities, and of the components of heavier edges beside it."""
    w = durable(_weights(_graph(spark, d)[1]))
    found = durable(communities.detect_communities(w, least_members=1))
    n = found.agg(F.count_distinct("community").alias("communities"), F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(graph.modularity(w, found.select("node", "community")).select(F.round("modularity", 6).alias("modularity")))


_COUNTING, _CORPUS = answering.COUNTING.replace("'", "''"), answering.CORPUS.replace("'", "''")


@query(f"""SELECT id, CASE WHEN regexp_matches(question, '(?i){_COUNTING}') THEN 'graph' WHEN regexp_matches(question, '(?i){_CORPUS}') THEN 'global' ELSE 'hybrid' END AS mode FROM gold""")
def route_questions(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval mode of every question."""
    return read_table(spark, d, "gold").select("id", answering.route(F.col("question")).alias("mode"))


@query(r"""WITH s AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\[(\d+)\]', 1) AS l FROM documents WHERE text IS NOT NULL)),
o AS (SELECT doc_id, CAST(x AS INT) AS num, min(pos) AS pos FROM s GROUP BY 1, 2)
SELECT doc_id, coalesce(list(num ORDER BY pos) FILTER (num BETWEEN 1 AND 8), []) AS cited, coalesce(list(num ORDER BY num) FILTER (num NOT BETWEEN 1 AND 8), []) AS dropped FROM o GROUP BY 1""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Citations of every document that has some, checked against eight sources."""
    docs = read_table(spark, d, "documents").filter(F.col("text").rlike(r"\[\d+\]"))
    return answering.citations(docs, "doc_id", "text", F.lit(8))


@query("""WITH u AS (SELECT event_type AS stage, user_id % 3 AS kind, CAST(floor(abs(value)) AS BIGINT) AS i, user_id AS o, user_id % 7 AS r, user_id % 5 AS w FROM events)
SELECT stage, count(*) AS calls, CAST(sum(i + o) AS BIGINT) AS tokens, round(sum(CASE WHEN kind = 0 THEN 0 ELSE (i + 1.25::DOUBLE * w + 0.1::DOUBLE * r) * 1.0 + o * 5.0 END) / 1e6, 6) AS cost FROM u GROUP BY 1""")
def usage_costs(spark: SparkSession, d: str) -> DataFrame:
    """K6, K7: usage by stage with cache reads and writes, every third user's model being unknown to the price list."""
    usage = read_table(spark, d, "events").select(
        F.col("event_type").alias("stage"), F.when(F.col("user_id") % 3 == 0, "other").otherwise("small").alias("model"), F.floor(F.abs("value")).cast("bigint").alias("input"),
        F.col("user_id").alias("output"), (F.col("user_id") % 7).alias("cache_read"), (F.col("user_id") % 5).alias("cache_write"),
    )
    return backend.usage_cost(usage, spark.createDataFrame([("small", 1.0, 5.0)], "model string, input_price double, output_price double"))


_RELEVANT = "rl AS (SELECT DISTINCT id, chunk_id FROM (SELECT id, unnest(relevant_papers) AS paper_id FROM gold) JOIN chunks USING (paper_id))"


@query(f"WITH {_RELEVANT} SELECT id, chunk_id FROM rl")
def gold_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the papers that a question names."""
    return evaluation.relevant_chunks(read_table(spark, d, "gold"), read_table(spark, d, "chunks"))


_TEXTS = "(SELECT chunk_id AS doc_id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY 1)"
_RANKED = _bm25_sql("question", 8, _TEXTS) + f""", {_RELEVANT}, dv AS {_HASHED.format(key="doc_id", text="text", table=_TEXTS)}, qv AS {_HASHED.format(key="id", text="question", table="gold")},
vs AS (SELECT id, doc_id, round(coalesce(CASE WHEN isnan(list_cosine_similarity(qv.v, dv.v)) THEN 0 ELSE list_cosine_similarity(qv.v, dv.v) END, 0), 6) AS score FROM qv, dv),
vk AS (SELECT id, doc_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 8),
rk AS (SELECT 'bm25' AS system, id, doc_id, rank FROM k WHERE score > 0 UNION ALL SELECT 'vector', id, doc_id, rank FROM vk),
rn AS (SELECT id, count(*) AS n_rel FROM rl GROUP BY 1), sy AS (SELECT unnest(['bm25', 'vector']) AS system),
hi AS (SELECT system, rk.id, rank, rl.chunk_id IS NOT NULL AS hit FROM rk LEFT JOIN rl ON rl.id = rk.id AND rl.chunk_id = rk.doc_id),
ga AS (SELECT system, id, count(*) FILTER (hit) AS hits, count(*) AS shown, min(rank) FILTER (hit) AS first FROM hi GROUP BY 1, 2),
ms AS (SELECT sy.system, rn.id, round(coalesce(hits, 0) / n_rel::DOUBLE, 4) AS recall, round(coalesce(1.0 / first, 0)::DOUBLE, 4) AS mrr FROM rn CROSS JOIN sy LEFT JOIN ga ON ga.id = rn.id AND ga.system = sy.system),
rs AS (SELECT sy.system, g.id, g.category, ms.recall, ms.mrr FROM gold g CROSS JOIN sy LEFT JOIN ms ON ms.id = g.id AND ms.system = sy.system)"""
_SUMMARY = _RANKED + """, su AS (SELECT system, unnest(['overall', category]) AS category, recall, mrr FROM rs), sm AS (SELECT system, category, count(*) AS n, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM su WHERE category IS NOT NULL GROUP BY 1, 2)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Results of the lexical and the vector search over all chunks for all questions, as benchmark rows."""
    gold, chunks = read_table(spark, d, "gold"), read_table(spark, d, "chunks")
    texts = chunks.filter("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text"))
    out = None
    for mode in ("bm25", "vector"):
        ranked = retrieval.hybrid_search(gold, "id", "question", texts, "chunk_id", "text", 8, mode)
        scores = evaluation.score_passages(ranked, gold, chunks)
        rows = gold.join(scores, "id", "left").select(F.lit(mode).alias("system"), "id", "category", "recall", "mrr", *[F.lit(None).cast("double").alias(c) for c in (*evaluation.SCORES, "tokens", "latency_s")], F.lit(None).cast("string").alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_SUMMARY + " SELECT system, category, n, recall, mrr FROM sm")
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    """Two systems on all questions, by system and by category."""
    return evaluation.summarise(_runs(spark, d)).select("system", "category", "n", "recall", "mrr")


@query(_SUMMARY + """ SELECT category, string_agg(system, ' / ' ORDER BY system) AS winner FROM (SELECT *, max(recall) OVER (PARTITION BY category) AS best FROM sm WHERE recall IS NOT NULL) WHERE abs(recall - best) < 1e-9 GROUP BY 1""")
def category_winners(spark: SparkSession, d: str) -> DataFrame:
    """The system of the best recall in each category, ties joined."""
    return evaluation.winners(evaluation.summarise(_runs(spark, d)), "recall")


@query(f"""SELECT category, CASE WHEN regexp_matches(question, '(?i){_COUNTING}') THEN 'graph' WHEN regexp_matches(question, '(?i){_CORPUS}') THEN 'global' ELSE 'hybrid' END AS mode, count(*) AS n, 1.0::DOUBLE AS calls FROM gold GROUP BY 1, 2""")
def route_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How the questions of each category are routed."""
    rows = read_table(spark, d, "gold").select("category", answering.route(F.col("question")).alias("mode"), F.lit(1).alias("calls"))
    return evaluation.route_histogram(rows)


@query("""SELECT r_name AS region, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def region_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path of three relations over the order tables as a typed graph."""
    t = lambda n: read_table(spark, d, n)
    edge = lambda df, rel, a, src, b, dst: df.select(F.lit(rel).alias("rel"), F.lit(a).alias("src_label"), F.col(src).cast("string").alias("src"), F.lit(b).alias("dst_label"), F.col(dst).cast("string").alias("dst"))
    edges = (
        edge(t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "IN_REGION", "Nation", "n_nationkey", "Region", "r_name")
        .unionByName(edge(t("customer"), "LIVES_IN", "Customer", "c_custkey", "Nation", "c_nationkey"))
        .unionByName(edge(t("orders"), "PLACED_BY", "Order", "o_orderkey", "Customer", "o_custkey"))
    )
    return Graph(edges).query("MATCH (o:Order)-[:PLACED_BY]->(c:Customer)-[:LIVES_IN]->(:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(DISTINCT c) AS customers, count(DISTINCT o) AS orders")

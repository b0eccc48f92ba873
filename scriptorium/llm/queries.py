"""The training-data queries of the registry, with their SQL where it is feasible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import canonical, canonlist, garbled, leaks, names, neardup, oversize, tokenize
from scriptorium.sources.tables import read_table

#: Fixed values of TESTDATA.md.
P1_SHINGLE, P1_SIMILARITY, P1_WORDS = 3, 0.6, 20
P6_CHUNKS, P6_WINDOWS = {"limit": 240, "overlap": 30}, {"limit": 1200, "overlap": 60}


def _p1(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = read_table(spark, sf_dir, "chunks").select("chunk_id", "text")
    return neardup.similar_classes(
        chunks, "chunk_id", "text", shingle_words=P1_SHINGLE, similarity=P1_SIMILARITY, least_words=P1_WORDS
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks whose texts have a similarity of at least 0.6."""
    membership, links = _p1(spark, sf_dir)
    return neardup.member_pairs(membership, links).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text, authors or name differ from their consistent form."""
    chunks = read_table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("item_key"), "text")
    papers = read_table(spark, sf_dir, "papers").select(
        F.lit("papers").alias("tbl"), F.col("paper_id").alias("item_key"), F.explode("authors").alias("text")
    )
    entities = read_table(spark, sf_dir, "entities").select(
        F.lit("entities").alias("tbl"), F.col("entity_id").cast("string").alias("item_key"), F.col("name").alias("text")
    )
    parts = [canonical.altered(t, "text").select("tbl", "item_key") for t in (chunks, papers, entities)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct chunk text, author and entity name that is altered, with its consistent form."""
    chunks = read_table(spark, sf_dir, "chunks").select("text")
    papers = read_table(spark, sf_dir, "papers").select(F.explode("authors").alias("text"))
    entities = read_table(spark, sf_dir, "entities").select(F.col("name").alias("text"))
    texts = chunks.unionByName(papers).unionByName(entities)
    return canonical.altered(texts, "text").select("text", "canonical").distinct()


def _p6(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    chunks = read_table(spark, sf_dir, "chunks")
    windows = read_table(spark, sf_dir, "windows")
    return (
        oversize.split_oversized(chunks, "chunk_id", with_text=with_text, **P6_CHUNKS)
        .withColumn("tbl", F.lit("chunks"))
        .unionByName(
            oversize.split_oversized(windows, "window_id", sections="sections", with_text=with_text, **P6_WINDOWS).withColumn("tbl", F.lit("windows"))
        )
    )


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized chunks and windows, with offsets and the sections a window's piece touches."""
    return _p6(spark, sf_dir, True).select("tbl", "item_key", "piece", "char_start", "char_end", "estimate", "sections", "text")


def p6_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets and estimates of all pieces of the oversized chunks and windows."""
    return _p6(spark, sf_dir, False).select("tbl", "item_key", "piece", "char_start", "char_end", "estimate")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that have to be cut: those with a second piece."""
    return _p6(spark, sf_dir, False).filter("piece = 1").select("tbl", "item_key").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_column(read_table(spark, sf_dir, "documents"), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share twelve consecutive words with a held-out question or reference."""
    gold = read_table(spark, sf_dir, "gold")
    found = leaks.leaked_passages(read_table(spark, sf_dir, "documents"), "doc_id", "text", gold, "id", ["question", "reference"])
    return found.select("doc_id", F.col("id").alias("item_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of every typed dataset, metric and method, -1 where it denotes none."""
    return canonlist.map_to_terms(
        read_table(spark, sf_dir, "result_claims"), "claim_id", ["dataset", "metric", "method"], read_table(spark, sf_dir, "canon_terms")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or one organisation."""
    authors = read_table(spark, sf_dir, "papers").select(F.lit("P").alias("kind"), F.explode("authors").alias("s"))
    kind = F.when(F.col("type") == "Author", "P").otherwise("O").alias("kind")
    entities = read_table(spark, sf_dir, "entities").filter(F.col("type").isin("Author", "Institution")).select(kind, "name", "aliases")
    typed = entities.select("kind", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s"))
    strings = authors.unionByName(typed).filter("s is not null").groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"))
    aliases = entities.select("kind", "name", F.explode("aliases").alias("alias"))
    linked = names.link_names(strings.filter("kind = 'P'").select("s", "n"), strings.filter("kind = 'O'").select("s", "n"), aliases)
    return names.spelling_pairs(linked)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with garbled spans."""
    return garbled.find_garbled(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their original text, null where something was lost."""
    return garbled.find_garbled(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "original").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_found": p6_found,
    "p6_cuts": p6_cuts,
    "p6_pieces": p6_pieces,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _cuts_sql() -> str:
    """Greedy cuts by recursion over the words of each oversized text."""
    parts = []
    for table, key, size in (("chunks", "chunk_id", P6_CHUNKS), ("windows", "window_id", P6_WINDOWS)):
        width, back = oversize.most_words(size["limit"]), oversize.most_words(size["overlap"])
        parts.append(f"SELECT DISTINCT '{table}' AS tbl, {key} AS item_key, text, {width} AS width, {back} AS back FROM {table} WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) > {width}")
    return f"""WITH RECURSIVE t AS ({" UNION ALL ".join(parts)}),
w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\r]+') AS ws, regexp_extract_all(text, '[ \t\n\r]+') AS ss, CASE WHEN regexp_matches(text, '^[ \t\n\r]') THEN 1 ELSE 0 END AS led FROM t),
n AS (SELECT *, list_filter(range(1, len(ws)), lambda j: regexp_matches(ss[j + led], '[\n\r]') OR regexp_matches(ws[j], '[.!?。！？…]["'')\\]”’»]$') OR regexp_matches(ws[j], '[.!?。！？…]$')) AS nat FROM w),
c AS (SELECT *, 0 AS a, CASE WHEN width >= len(ws) THEN len(ws) ELSE coalesce(list_max(list_filter(nat, lambda j: j > back AND j <= width)), width) END AS b FROM n
UNION ALL SELECT * EXCLUDE (x), CASE WHEN x + width >= len(ws) THEN len(ws) ELSE coalesce(list_max(list_filter(nat, lambda j: j > x + back AND j <= x + width)), x + width) END
FROM (SELECT * EXCLUDE (a, b), b - back AS a, b - back AS x FROM c WHERE b < len(ws)))
SELECT DISTINCT tbl, item_key, CAST(row_number() OVER (PARTITION BY tbl, item_key, text ORDER BY a) - 1 AS INT) AS piece,
CAST(CASE WHEN a = 0 THEN 0 ELSE length(array_to_string(ws[1:a], '')) + length(array_to_string(ss[1:a + led], '')) END AS INT) AS char_start,
CAST(CASE WHEN b = len(ws) THEN length(text) ELSE length(array_to_string(ws[1:b], '')) + length(array_to_string(ss[1:b - 1 + led], '')) END AS INT) AS char_end,
CAST(floor(1.3::DOUBLE * (b - a)) AS INT) AS estimate FROM c"""


ORACLE: dict[str, str] = {
    "p6_cuts": _cuts_sql(),
    "p1_found": f"""WITH t AS (SELECT DISTINCT chunk_id, {_TOKENS} AS w FROM chunks WHERE text IS NOT NULL),
g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM t WHERE len(w) >= 20),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT chunk_id_a, chunk_id_b FROM c JOIN n x ON x.chunk_id = chunk_id_a JOIN n y ON y.chunk_id = chunk_id_b WHERE 10 * c >= 6 * (x.n + y.n - c)""",
    "p6_found": r"""SELECT DISTINCT 'chunks' AS tbl, chunk_id AS item_key FROM chunks
WHERE floor(1.3::DOUBLE * len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''))) > 240
UNION SELECT DISTINCT 'windows', window_id FROM windows
WHERE floor(1.3::DOUBLE * len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> ''))) > 1200""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT id, {_TOKENS} AS w FROM (SELECT id, question AS text FROM gold UNION ALL SELECT id, reference FROM gold) WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS s FROM d WHERE len(w) >= 12),
y AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS s FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, id AS item_id FROM x JOIN y USING (s)""",
}

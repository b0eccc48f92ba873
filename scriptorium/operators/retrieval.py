"""Lexical and vector retrieval and their fusion.

The lexical index is one row a document with its terms and counts, beside a table of term statistics: the corpus is
tokenised once. Searches send blocks of queries (bounded, measured in rows) to where the documents lie; each batch of
documents is scored by array steps and keeps its k best of each query, so only k rows a query and batch are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from scriptorium.functions.tokens import lexical_tokens
from scriptorium.sources.tables import durable, spread

#: Okapi parameters and the rank constant of the fusion.
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Fixed value: what a query starts with for embedding models that are trained with an instruction.
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
TOP_K = 8
#: Queries of a block, and scores that a task holds at once.
BLOCK_QUERIES, SCORES_AT_ONCE = 2_000, 4_000_000
Embedding = Callable[[Column], Column]


# ---- lexical index
@dataclass(frozen=True)
class LexicalIndex:
    """`docs` (key, length, terms, counts), `terms` (term, df, idf) and the totals that a score needs."""

    docs: DataFrame
    terms: DataFrame
    total: int
    mean_length: float

    def save(self, path: str) -> None:
        """Write the index as tables under `path`, over what was there."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        totals = self.docs.sparkSession.createDataFrame([(self.total, self.mean_length)], "total bigint, mean_length double")
        totals.write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        """The index stored under `path`."""
        total, mean = spark.read.parquet(f"{path}/totals").first()
        return LexicalIndex(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/terms"), total, mean)


_TERMS = re.compile("[a-z0-9]+").findall


def build_index(docs: DataFrame, key: str, text: str) -> LexicalIndex:
    """The lexical index of `docs`: every row counts as a document, those without a token are found by no query.

    Okapi idf; negative ones are replaced by EPSILON times the mean over all terms.
    """
    narrow = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()), "key")
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(_TERMS(t.lower())) for t in batch.column(1).to_pylist()]
            kept = [i for i, c in enumerate(counts) if c]
            columns = [batch.column(0).take(pa.array(kept, pa.int32())), pa.array([sum(counts[i].values()) for i in kept], pa.int32())]
            columns += [pa.array([list(counts[i]) for i in kept], pa.list_(pa.string())), pa.array([list(counts[i].values()) for i in kept], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "length", "terms", "counts"])

    index = durable(narrow.mapInArrow(run, f"key {kind}, length int, terms array<string>, counts array<int>"))
    total = docs.count()
    length = index.agg(F.sum("length")).first()[0] or 0
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = durable(df.withColumn("raw", F.log(F.lit(total) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(index, terms, total, length / total if total else 0.0)


def _query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """Blocks of about BLOCK_QUERIES rows of `queries` (q, ...), by a hash of q."""
    count = -(-queries.count() // BLOCK_QUERIES)
    for number in range(count):
        yield queries if count == 1 else queries.filter(F.pmod(F.xxhash64("q"), F.lit(count)) == number)


def _all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    """The union of the parts; more than one is written first, so that the plan stays small."""
    if not parts:
        return empty
    out = parts[0] if len(parts) == 1 else durable(parts[0])
    for part in parts[1:]:
        out = out.unionByName(durable(part))
    return out


def _best(scores: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each column, ties to the earlier row; only above `floor` if there is one."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
        row, column = np.nonzero(scores >= edge[None, :])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    if floor is not None:
        good = scores[row, column] > floor
        row, column = row[good], column[good]
    order = np.lexsort((row, -scores[row, column], column))
    row, column = row[order], column[order]
    first = np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)
    place = np.arange(len(column)) - np.repeat(first, np.diff(np.r_[first, len(column)]))
    return row[place < k], column[place < k]


def search_index(queries: DataFrame, query_key: str, query_text: str, index: LexicalIndex, key: str, k: int = TOP_K) -> DataFrame:
    """(query_key, key, score, rank): the k best documents of each query with a positive score, ties by key.

    Repeated query tokens count again. Scores are rounded to six places.
    """
    said = queries.select(F.col(query_key).alias("q"), F.col(query_text).alias("text"))
    kinds = f"q {said.schema['q'].dataType.simpleString()}, k {index.docs.schema['key'].dataType.simpleString()}, score double"
    query_type, mean, parts = to_arrow_type(said.schema["q"].dataType), index.mean_length, []
    for block in _query_blocks(said):
        asked = block.select("q", F.explode(lexical_tokens(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
        rows = asked.join(index.terms, "term").select("q", "term", (F.col("times") * F.col("idf")).alias("w")).orderBy("term").collect()
        if not rows:
            continue
        names = sorted({r.q for r in rows})
        column = {q: i for i, q in enumerate(names)}
        terms = sorted({r.term for r in rows})
        place = {t: i for i, t in enumerate(terms)}
        of = np.array([place[r.term] for r in rows])
        to, weight = np.array([column[r.q] for r in rows]), np.array([r.w for r in rows])
        first = np.searchsorted(of, np.arange(len(terms) + 1))

        def run(batches: Iterator[pa.RecordBatch], names=names, terms=terms, to=to, weight=weight, first=first) -> Iterator[pa.RecordBatch]:
            wanted, step = pa.array(terms), max(1, SCORES_AT_ONCE // len(names))
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    batch = batch.take(pc.sort_indices(batch.column(0)))  # ties go by key
                    lists = batch.column(2)
                    term = pc.index_in(lists.flatten(), value_set=wanted)
                    known = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
                    if not len(known):
                        continue
                    term = term.fill_null(0).to_numpy(zero_copy_only=False)[known]
                    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    doc = np.repeat(np.arange(batch.num_rows), sizes)[known]
                    tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)[known]
                    length = batch.column(1).to_numpy(zero_copy_only=False)[doc]
                    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                    many = first[term + 1] - first[term]
                    at = np.repeat(first[term] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                    cell = np.repeat(doc, many) * len(names) + to[at]
                    scores = np.bincount(cell, np.repeat(part, many) * weight[at], batch.num_rows * len(names)).reshape(-1, len(names))
                    row, query = _best(np.round(scores, 6), k, 0.0)
                    asked_by = pa.array([names[i] for i in query], query_type)
                    yield pa.RecordBatch.from_arrays([asked_by, batch.column(0).take(pa.array(row)), pa.array(np.round(scores[row, query], 6))], names=["q", "k", "score"])

        parts.append(index.docs.select("key", "length", "terms", "counts").mapInArrow(run, kinds))
    found = _all(parts, said.sparkSession.createDataFrame([], kinds))
    return top_k(found.select(F.col("q").alias(query_key), F.col("k").alias(key), "score"), query_key, key, k)


def bm25_search(queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, k: int = TOP_K) -> DataFrame:
    """`search_index` over a fresh index of `docs`."""
    return search_index(queries, query_key, query_text, build_index(docs, key, text), key, k)


def top_k(scored: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """The k best of each query, best first, ties by key."""
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(query_key, key, "score", "rank")


# ---- vectors
def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(queries: DataFrame, query_key: str, query_vector: str, rows: DataFrame, key: str, vector: str, k: int = TOP_K) -> DataFrame:
    """(query_key, key, score, rank): exact cosine top k of a stated query set against all rows, in blocks.

    Each block of queries is one matrix; each batch of rows keeps its k best of each query. Zero vectors score 0; null
    vectors have no row; keys are not null. Scores are rounded to six places, whatever the number of queries.
    """
    asked = durable(queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v")).filter("v is not null"))
    wanted = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).filter("v is not null")
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, k {wanted.schema['k'].dataType.simpleString()}, score double"
    query_type, parts = to_arrow_type(asked.schema["q"].dataType), []
    for block in _query_blocks(asked):
        held = block.orderBy("q").collect()
        if not held:
            continue
        matrix = np.array([r.v for r in held], dtype=np.float64)
        sizes = np.linalg.norm(matrix, axis=1)
        matrix /= np.where(sizes > 0, sizes, 1.0)[:, None]
        names = pa.array([r.q for r in held])

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix) -> Iterator[pa.RecordBatch]:
            step = max(1, SCORES_AT_ONCE // len(matrix))
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    batch = whole.slice(lo, step)
                    batch = batch.take(pc.sort_indices(batch.column(0)))  # ties go by key
                    vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64)
                    lengths = np.linalg.norm(vectors, axis=1)
                    scores = np.round(vectors / np.where(lengths > 0, lengths, 1.0)[:, None] @ matrix.T, 6) + 0.0
                    row, query = _best(scores, k, None)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(query)).cast(query_type), batch.column(0).take(pa.array(row)), pa.array(scores[row, query])], names=["q", "k", "score"])

        parts.append(wanted.mapInArrow(run, kinds))
    found = _all(parts, asked.sparkSession.createDataFrame([], kinds))
    return top_k(found.select(F.col("q").alias(query_key), F.col("k").alias(key), "score"), query_key, key, k)


@lru_cache(maxsize=1_000_000)
def _bucket(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:6], 16)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic term vector: each token adds one at its hash; stands in for a model when none is given.

    The place of a token is the number of the first six digits of its MD5, modulo `dim`. Null and empty texts give the
    zero vector. Vectorised in Arrow batches, so a plan evaluates it once a row.
    """

    def embed(texts: pd.Series) -> pd.Series:
        at = ([_bucket(w) % dim for w in _TERMS(t.lower())] if t else [] for t in texts)
        return pd.Series([np.bincount(np.array(x, dtype=np.int64), minlength=dim).astype(np.float32) for x in at])

    return F.pandas_udf(embed, ArrayType(FloatType()))(text)


# ---- fusion
def fuse(lists: list[tuple[str, DataFrame]], query_key: str, key: str, limit: int | None = None) -> DataFrame:
    """(query_key, key, score, source, rank): reciprocal-rank fusion of ranked lists (query_key, key, rank).

    Sources are joined in order with "+"; ties go to the row that appears first, list by list.
    """
    parts = [d.select(query_key, key, "rank", F.lit(name).alias("source"), F.lit(n).alias("list")) for n, (name, d) in enumerate(lists)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    fused = every.groupBy(query_key, key).agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
        F.min(F.struct("list", "rank")).alias("first"),
    )
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), "first", key)
    ranked = fused.withColumn("rank", F.row_number().over(order)).select(query_key, key, "score", "source", "rank")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def hybrid_search(
    queries: DataFrame, query_key: str, query_text: str, docs: DataFrame, key: str, text: str, k: int = TOP_K, mode: str = "hybrid", *,
    embed: Embedding = hashed_embedding, instruction: str = "", index: LexicalIndex | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """Top k by "bm25", "vector" or their fusion; each retriever over-fetches max(2k, 20) before the fusion.

    `embed` is the model, `instruction` what it wants before a query; `index` and `vectors` (key, vector) are stored ones.
    """
    if mode not in ("hybrid", "vector", "bm25"):
        raise ValueError(f"unknown mode {mode!r}")
    wide = k if mode != "hybrid" else max(2 * k, 20)
    lists = []
    if mode != "bm25":
        q = queries.select(query_key, embed(F.concat(F.lit(instruction), F.col(query_text))).alias("v"))
        rows = vectors if vectors is not None else docs.select(key, embed(F.col(text)).alias("vector"))
        lists.append(("vector", vector_search(q, query_key, "v", rows, key, "vector", wide)))
    if mode != "vector":
        lists.append(("bm25", search_index(queries, query_key, query_text, index or build_index(docs, key, text), key, wide)))
    return fuse(lists, query_key, key, k)


# ---- metrics
def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, query_key: str, key: str, k: int = TOP_K) -> DataFrame:
    """(query_key, recall, precision, mrr, ndcg) rounded to 4: `ranked` has rank, `relevant` one row a relevant key.

    Queries without a relevant key score 0; queries without results have a row if they have relevant keys.
    """
    rel = relevant.select(query_key, key).distinct().withColumn("hit", F.lit(1))
    sizes = rel.groupBy(query_key).agg(F.count(F.lit(1)).alias("n_rel"))
    got = ranked.join(rel, [query_key, key], "left").groupBy(query_key).agg(
        F.count_distinct(F.when((F.col("rank") <= k) & (F.col("hit") == 1), F.col(key))).alias("hits"),
        F.least(F.lit(k), F.count(F.lit(1))).alias("shown"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    both = got.join(sizes, query_key, "full")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return both.select(
        query_key,
        zero(F.col("hits") / F.col("n_rel")).alias("recall"),
        zero(F.col("hits") / F.col("shown")).alias("precision"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / F.when(F.col("n_rel") > 0, ideal)).alias("ndcg"),
    )


def mean_metrics(scores: DataFrame, *by: str) -> DataFrame:
    """The mean of each metric over the questions, by the columns `by`, rounded to 4."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "mrr", "ndcg")], F.count(F.lit(1)).alias("n"))

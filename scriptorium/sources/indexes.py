"""Stored tables that are replaced as a whole, and the vector store on top of them.

A stored table is a folder of versions. A write makes a new version and then drops older ones, so a reader never sees half
a table and a plan may read the version that it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.retrieval import TOP_K, Embedding, hashed_embedding, vector_search


class StoredTable:
    """A table under `path` that is overwritten as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.place = place

    def _path(self, version: int):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version}")

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        if not self.files.exists(self.place):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.place)]
        numbers = [int(n[2:]) for n in names if n.startswith("v=")]
        success = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in numbers if self.files.exists(success(f"{self.path}/v={n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The last complete version; None before the first write."""
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={known[-1]}") if known else None

    def write(self, df: DataFrame) -> None:
        """Replace the table by `df`, which may read it."""
        known = self.versions()
        number = known[-1] + 1 if known else 0
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for old in known:
            self.files.delete(self._path(old), True)


class VectorStore:
    """Vectors of chunks (chunk_id, paper_id, vector) that a paper's new chunks replace."""

    def __init__(self, spark: SparkSession, path: str, embed: Embedding = hashed_embedding, instruction: str = ""):
        self.table, self.embed, self.instruction = StoredTable(spark, path), embed, instruction

    def add(self, chunks: DataFrame) -> int:
        """Embed chunks (chunk_id, paper_id, text) in place of all their papers' earlier ones; how many were added (A10)."""
        fresh = chunks.select("chunk_id", "paper_id", self.embed(F.col("text")).alias("vector")).dropDuplicates(["chunk_id"])
        before = self.table.read()
        if before is not None:
            fresh = fresh.unionByName(before.join(chunks.select("paper_id").distinct(), "paper_id", "left_anti").select(*fresh.columns))
        self.table.write(fresh)
        return self.table.read().join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").count()

    def delete_paper(self, paper_id: str) -> None:
        """Drop the vectors of a paper."""
        before = self.table.read()
        if before is not None:
            self.table.write(before.filter(~F.col("paper_id").eqNullSafe(F.lit(paper_id))))

    def count(self) -> int:
        """Stored vectors."""
        rows = self.table.read()
        return 0 if rows is None else rows.count()

    def reset(self) -> None:
        """Drop all vectors."""
        before = self.table.read()
        if before is not None:
            self.table.write(before.limit(0))

    def search(self, queries: DataFrame, query_key: str, query_text: str, k: int = TOP_K) -> DataFrame:
        """(query_key, chunk_id, score, rank) of the stored vectors; the query gets the model's instruction."""
        asked = queries.select(query_key, self.embed(F.concat(F.lit(self.instruction), F.col(query_text))).alias("v"))
        return vector_search(asked, query_key, "v", self.table.read(), "chunk_id", "vector", k)

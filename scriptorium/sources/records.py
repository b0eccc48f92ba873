"""JSON-lines sources and sinks of the pipeline's logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTRACTION = (
    "seq bigint, window_id string, paper_id string, char_start int, char_end int, status string, error string, "
    "extraction struct<entities:array<struct<name:string,type:string,aliases:array<string>,description:string>>,"
    "relations:array<struct<subject:string,predicate:string,object:string,evidence:string,confidence:double>>,"
    "results:array<struct<method:string,dataset:string,metric:string,value:double,evidence:string>>>"
)
GOLD = "id string, question string, category string, reference string, relevant_papers array<string>, notes string"


def read_log(spark: SparkSession, path: str, schema: str = EXTRACTION) -> DataFrame:
    """A JSON-lines log; blank and malformed lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*").filter("_bad is null").drop("_bad")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines file of which every line has to parse."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended to a JSON-lines log; the committer makes each append whole."""
    df.write.mode("append").json(path)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a finished record."""
    return items.join(done.select(key), key, "left_anti")


def whole_files(spark: SparkSession, path: str, least_bytes: int = 10_000) -> DataFrame:
    """(path, length, content) of binary files that are not cut short."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") >= least_bytes).select("path", "length", "content")

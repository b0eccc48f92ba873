"""Table access, durable cuts of lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes (measured, uncompressed) up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16_000_000
#: Bytes of a value without a length of its own, and of a row.
FIXED_BYTES = 8
#: Where the files of a durable frame lie, kept on the frame.
_PATH = "_scriptorium_path"
#: Whether a frame was small enough to be marked for broadcast, kept on the frame.
_SMALL = "_scriptorium_small"
#: Setting that removes the shuffle files of a plan when it has run.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session under the cluster's spark.checkpoint.dir.

    Only where that is unset, and only on a local master, a folder is made; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="scriptorium-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame, *, tidy: bool = False) -> DataFrame:
    """`df` written as a table to the shared folder and read back: its lineage ends there, lost executors lose nothing.

    Columnar and compressed, so later stages read only the columns they need. The files go with `release`, at the latest
    when the driver ends. With `tidy` the shuffle files of the plan go once it has run, not when the driver next collects
    its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scriptorium-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_TIDY)
        elif tidy:
            spark.conf.set(_TIDY, before)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the files of durable frames that no later plan reads."""
    for df in frames:
        if path := getattr(df, _PATH, None):
            place, files = _place(df.sparkSession, path)
            files.delete(place, True)


def _bytes(df: DataFrame) -> Column:
    """Bytes of a row: the lengths of its strings and of the text of its nested values, else a fixed size each."""
    total = F.lit(FIXED_BYTES)
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + FIXED_BYTES
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + FIXED_BYTES
        else:
            total = total + FIXED_BYTES
    return total.cast("bigint")


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """(`df` as a durable table, its rows, its bytes), by one run of its plan."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_bytes(df)).alias("bytes")))
    said = seen.get
    return out, said["rows"] or 0, said["bytes"] or 0


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """`df` as a durable table, marked for broadcast if its measured bytes are at most `limit` (BROADCAST_BYTES).

    Beyond the limit Catalyst and AQE choose a shuffled join, so results never depend on the choice.
    """
    out, _, size = measured(df)
    small = size <= (BROADCAST_BYTES if limit is None else limit)
    out = F.broadcast(out) if small else out
    setattr(out, _SMALL, small)
    return out


def measured_once(df: DataFrame) -> DataFrame:
    """`df` if it came from `broadcast_if_small`, else that of it."""
    return df if hasattr(df, _SMALL) else broadcast_if_small(df)


def hinted(df: DataFrame, like: DataFrame) -> DataFrame:
    """`df`, a projection of `like`, marked for broadcast if `like` is: a projection hides the mark from the join."""
    return F.broadcast(df) if getattr(like, _SMALL, False) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over enough partitions for a stage that spends CPU on each row.

    Input that already has as many partitions as the session has cores stays as it is; only input in a few files is
    shuffled, by `keys`.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *[F.col(k) for k in keys])

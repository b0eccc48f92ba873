"""Connected components as DataFrame iterations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.tables import durable, measured, release

#: Bytes (measured) of an edge list up to which its rounds are not worth their overhead; the result is the same.
ONE_TASK_BYTES = 16_000_000


def _in_one_task(links: DataFrame) -> DataFrame:
    """(node, component) of a bounded edge list by union-find in one task; a component is named by its least node."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        types = None

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            types = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for node in (x, y):
                    above.setdefault(node, node)
                x, y = root(x), root(y)
                above[max(x, y)] = min(x, y)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), types), pa.array([root(x) for x in above], types)], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task_bytes: int | None = None) -> DataFrame:
    """(node, component) of an undirected edge list; a component is named by its least node.

    Alternating large-star and small-star rounds on the edge list (Kiveris et al. 2014): the number of rounds grows with
    the logarithm of the component, and no node's whole neighbourhood is collected. Null endpoints and self-loops are
    ignored, repeated edges count once, an empty list gives no rows. Each round is written once, and the table of the
    round before is deleted. A list of few bytes (measured) is closed in one task: the same components without rounds.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    links, _, size = measured(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if size <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes):
        return durable(_in_one_task(links))
    digest = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1))))
    seen = links.agg(digest).first()
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, links = links, durable(small.distinct())
        release(before)
        # Done once a round changes nothing: every node then hangs on its component's least node alone.
        said = links.agg(digest).first()
        if said == seen:
            break
        seen = said
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )

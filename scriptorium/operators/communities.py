"""Communities of a weighted graph: Leiden in rounds of parallel moves (H2), their summaries and tables (H4-H6).

A level moves nodes between communities until no move gains, refines each community from single nodes so that it is
connected, and aggregates the refined graph; the moved communities are where the next level starts. A round makes many
moves, each of which raises the modularity whatever order they are made in. One rule for every graph: a list of few bytes
(measured) runs the same rounds as array steps in one task, a larger one as DataFrames.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.operators.backend import Backend
from scriptorium.sources.tables import durable, measured, release

LEAST_MEMBERS = 3
#: Least gain of a move, absolute and as a share of the graph's degrees: below it a gain may be rounding alone.
LEAST_GAIN, LEAST_SHARE = 1e-9, 1e-13
#: Bytes (measured) of an edge list up to which its rounds run in one task; the partition is the same.
ONE_TASK_BYTES = 16_000_000
SUMMARY_TOKENS = 1200
SUMMARY_PROMPT = "Name the common theme of these entities and relations in a short title, then describe it in two or three sentences. Answer as JSON with title and summary."


# ---- rounds as array steps
def _move_arrays(nodes: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, own: np.ndarray, k: np.ndarray, total: float, resolution: float, singles: bool, names: np.ndarray) -> int:
    """`own` (node -> community, changed in place) after moves that each gain, until none is left; how many were made."""
    size, least = len(own), max(LEAST_GAIN, LEAST_SHARE * total)
    apart = x != y
    src, dst, weight = np.r_[x[apart], y[apart]], np.r_[y[apart], x[apart]], np.r_[w[apart], w[apart]]
    moved, turn = 0, 0
    while True:
        tot, members = np.bincount(own[nodes], k[nodes], size), np.bincount(own[nodes], minlength=size)
        pair, inverse = np.unique(src * size + own[dst], return_inverse=True)
        into = np.bincount(inverse, weight, len(pair)) if len(pair) else np.zeros(0)
        node, target = pair // size, pair % size
        source = own[node]
        inside = np.zeros(size)
        stays = target == source
        inside[node[stays]] = into[stays]
        share = resolution * k[node] / total
        gain = np.round(into - inside[node] - share * (tot[target] - (tot[source] - k[node])), 9)
        good = ~stays & (gain > least) & ((members[source] == 1) if singles else True)
        node, target, gain, share = node[good], target[good], gain[good], share[good]
        order = np.lexsort((target, gain, node))
        last = order[np.r_[node[order][1:] != node[order][:-1], True]] if len(order) else order
        node, target, gain, share = node[last], target[last], gain[last], share[last]
        if not len(node):
            return moved
        source = own[node]
        if turn % 2 == 0:  # the role of a community is that of the highest move that touches it
            touched = np.r_[source, target]
            takes = np.r_[np.zeros(len(node), bool), np.ones(len(node), bool)]
            rank = np.lexsort((np.r_[node, node], np.r_[gain, gain], touched))
            role = np.zeros(size, bool)
            role[touched[rank]] = takes[rank]
        else:  # a coin's, which breaks chains of moves that wait for each other
            role = np.zeros(size, bool)
            for c in np.unique(np.r_[source, target]):
                role[c] = zlib.crc32(f"{names[c]}/{turn}".encode()) % 2 == 0
        ready = ~role[source] & role[target]
        node, source, target, gain, share = (a[ready] for a in (node, source, target, gain, share))
        order = np.lexsort((-node, -gain))
        node, source, target, gain, share = (a[order] for a in (node, source, target, gain, share))
        ahead = np.zeros(len(node))
        for side in (target, source):
            by = np.argsort(side, kind="stable")
            run = np.cumsum(k[node[by]]) - k[node[by]]
            first = np.r_[True, side[by][1:] != side[by][:-1]] if len(by) else np.zeros(0, bool)
            ahead[by] += run - np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(by)]))
        made = gain - share * ahead > least
        own[node[made]] = target[made]
        moved += int(made.sum())
        turn += 1


def _leiden_arrays(x: np.ndarray, y: np.ndarray, w: np.ndarray, names: np.ndarray, resolution: float) -> np.ndarray:
    """Community (a node's number) of every node of the edges (x, y, w); numbers follow the order of the names."""
    size = len(names)
    membership, nodes, own = np.arange(size), np.arange(size), np.arange(size)
    while True:
        k = np.bincount(x, w, size) + np.bincount(y, w, size)
        total = k.sum()
        _move_arrays(nodes, x, y, w, own, k, total, resolution, False, names)
        fine, within = np.arange(size), own[x] == own[y]
        merged = _move_arrays(nodes, x[within], y[within], w[within], fine, k, total, resolution, True, names)
        if not merged:
            return own[membership]
        membership = fine[membership]
        start = own.copy()
        own = np.arange(size)
        nodes = np.unique(fine[nodes])
        own[nodes] = start[nodes]
        x, y = np.minimum(fine[x], fine[y]), np.maximum(fine[x], fine[y])
        pair, inverse = np.unique(x * size + y, return_inverse=True)
        x, y, w = pair // size, pair % size, np.bincount(inverse, w)


def _in_one_task(weights: DataFrame, resolution: float) -> DataFrame:
    kind = weights.schema["a"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat([pd.DataFrame({"a": [], "b": [], "weight": []}), *frames])
        if len(edges):
            names, codes = np.unique(np.r_[edges["a"].to_numpy(), edges["b"].to_numpy()], return_inverse=True)
            a, b = codes[: len(edges)], codes[len(edges) :]
            found = _leiden_arrays(np.minimum(a, b), np.maximum(a, b), edges["weight"].to_numpy(float), names, resolution)
            yield pd.DataFrame({"node": names, "community": names[found]})

    return weights.select("a", "b", "weight").coalesce(1).mapInPandas(run, f"node {kind}, community {kind}")


# ---- the same rounds as DataFrames
def _local_moves(weights: DataFrame, start: DataFrame, degree: DataFrame, total: float, resolution: float, singles: bool = False) -> tuple[DataFrame, int]:
    """(node, community) from `start` after moves that each gain, until none is left; how many were made.

    In a round a community either gives or takes, so a move never meets another one's target as its source. By turns its
    role is that of the highest (gain, node) move that touches it, which always lets the highest of all through, and a
    coin's. Each move ahead with the same target or source lowers a gain by at most share times its degree, so a move is
    made where its gain still holds after all moves ahead of it. `singles`: only nodes that are alone move (refinement).
    """
    apart = weights.filter("a <> b")
    both = durable(apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    place = durable(start.select("node", "community"))
    least = max(LEAST_GAIN, LEAST_SHARE * total)
    moved, turn = 0, 0
    while True:
        tot = place.join(degree, place.node == degree.a).groupBy("community").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"))
        near = both.join(place.withColumnRenamed("node", "b").withColumnRenamed("community", "target"), "b")
        links = near.groupBy("a", "target").agg(F.sum("weight").alias("w"))
        wide = links.join(place.select(F.col("node").alias("a"), F.col("community").alias("source")), "a").join(degree, "a")
        inside = wide.filter("target = source").select("a", F.col("w").alias("w_own"))
        offers = (
            wide.filter("target <> source").join(inside, "a", "left")
            .join(tot.select(F.col("community").alias("target"), F.col("tot").alias("tot_t")), "target")
            .join(tot.select(F.col("community").alias("source"), F.col("tot").alias("tot_s"), "members"), "source")
        )
        offers = offers.filter("members = 1") if singles else offers
        share = resolution * F.col("k") / F.lit(total)
        gain = F.col("w") - F.coalesce("w_own", F.lit(0.0)) - share * (F.col("tot_t") - (F.col("tot_s") - F.col("k")))
        offers = offers.withColumn("gain", F.round(gain, 9)).withColumn("share", share).filter(F.col("gain") > least)
        best = offers.groupBy("a").agg(F.max_by(F.struct("source", "target", "gain", "share", "k"), F.struct(F.col("gain"), F.col("target"))).alias("m")).select("a", "m.*")
        best = durable(best)
        if best.isEmpty():
            release(both, best)
            return place, moved
        touches = best.select("a", "gain", F.explode(F.array(F.struct(F.col("source").alias("c"), F.lit(False).alias("takes")), F.struct(F.col("target").alias("c"), F.lit(True).alias("takes")))).alias("t"))
        coin = F.crc32(F.concat(F.col("t.c").cast("string"), F.lit(f"/{turn}"))) % 2 == 0
        first = F.max_by("t.takes", F.struct(F.col("gain"), F.col("a"))) if turn % 2 == 0 else F.bool_or(coin)
        roles = touches.groupBy(F.col("t.c").alias("c")).agg(first.alias("takes"))
        giving, taking = (roles.filter(F.col("takes") == t).select(F.col("c").alias(n)) for n, t in (("source", False), ("target", True)))
        ahead = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(F.desc("gain"), F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ready = best.join(giving, "source").join(taking, "target").withColumn("ahead", ahead("target")).withColumn("ahead", F.col("ahead") + ahead("source"))
        chosen = ready.filter(F.col("gain") - F.col("share") * F.col("ahead") > least).select(F.col("a").alias("node"), "target")
        after = durable(place.join(chosen, "node", "left").select("node", F.coalesce("target", "community").alias("community"), F.col("target").isNotNull().alias("new")))
        moved += after.filter("new").count()
        release(place, best)
        place = after
        turn += 1


def _in_rounds(start: DataFrame, resolution: float) -> DataFrame:
    level = start
    place = durable(start.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("community", F.col("node")))
    membership = place.select("node", F.col("node").alias("at"))
    while True:  # every level with a merge has fewer nodes than the one before
        ends = level.select("a", "weight").unionByName(level.select(F.col("b").alias("a"), "weight"))
        degree = durable(ends.groupBy("a").agg(F.sum("weight").alias("k")))
        total = degree.agg(F.sum("k")).first()[0] or 0.0
        place, _ = _local_moves(level, place, degree, total, resolution)
        side = lambda n, of: of.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}"))
        within = durable(level.join(side("a", place), "a").join(side("b", place), "b").filter("c_a = c_b").select("a", "b", "weight"))
        alone = place.select("node", F.col("node").alias("community"))
        fine, merged = _local_moves(within, alone, degree, total, resolution, True)
        if not merged:
            return membership.join(place.select(F.col("node").alias("at"), "community"), "at").select("node", "community")
        membership = durable(membership.join(fine.select(F.col("node").alias("at"), F.col("community").alias("next")), "at").select("node", F.col("next").alias("at")))
        ends = level.join(side("a", fine), "a").join(side("b", fine), "b")
        level = durable(ends.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("weight").alias("weight")))
        place = durable(fine.select(F.col("community").alias("node")).distinct().join(place.select("node", "community"), "node"))


def detect_communities(weights: DataFrame, resolution: float = 1.0, least_members: int = LEAST_MEMBERS, one_task_bytes: int | None = None) -> DataFrame:
    """(node, community, size) of undirected weights (a, b, weight); communities of fewer members are left out.

    Rows with a null end, loops and weights that are not positive are ignored, repeated edges add up. Deterministic: ties
    go by node. Every community is connected; it is named by its least member.
    """
    clean = weights.filter("a is not null and b is not null and a <> b and weight > 0")
    start, _, size = measured(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    small = size <= (ONE_TASK_BYTES if one_task_bytes is None else one_task_bytes)
    membership = _in_one_task(start, resolution) if small else _in_rounds(start, resolution)
    named = membership.groupBy("community").agg(F.min("node").alias("name"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least_members)
    return membership.join(named, "community").select("node", F.col("name").alias("community"), "size")


# ---- summaries and tables
def summarise_communities(contexts: DataFrame, make_backend: Callable[[], Backend]) -> DataFrame:
    """(community_id, title, summary) of contexts (community, size, context); a failure leaves a title with the size (H4).

    The backend is made once a task; its answer is JSON with a title and a summary.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for frame in frames:
            rows = []
            for name, size, context in zip(frame["community"], frame["size"], frame["context"]):
                try:
                    said = backend.parse(SUMMARY_PROMPT, context or "", ["title", "summary"], SUMMARY_TOKENS)
                    rows.append((name, said["title"] or f"Cluster of {size} entities", said["summary"] or ""))
                except Exception:  # noqa: BLE001 - one failure does not stop the others
                    rows.append((name, f"Cluster of {size} entities", ""))
            yield pd.DataFrame(rows, columns=["community_id", "title", "summary"])

    return contexts.select(F.col("community").cast("string").alias("community"), "size", "context").mapInPandas(run, "community_id string, title string, summary string")


def community_nodes(members: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(community_id, level, title, summary, size) of members (node, community, size) with their summaries (H5)."""
    one = members.groupBy(F.col("community").cast("string").alias("community_id")).agg(F.max("size").cast("bigint").alias("size"))
    if summaries is None:
        return one.select("community_id", F.lit(0).cast("bigint").alias("level"), F.lit("").alias("title"), F.lit("").alias("summary"), "size")
    return one.join(summaries, "community_id", "left").select("community_id", F.lit(0).cast("bigint").alias("level"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), "size")


def load_communities(nodes: DataFrame) -> DataFrame:
    """Stored communities, the largest first, ties by id (H6)."""
    return nodes.select("community_id", "title", "summary", "size").orderBy(F.desc("size"), "community_id")

"""Held-out items inside a corpus: a prefix-filtered set join (problem 8).

A document contains a passage of an item if both have `span` consecutive words in common. Each window of `span` words
of an item is a set of word shingles; the shingles are ordered by their document frequency in the whole corpus and the
rarest is the window's necessary prefix. The corpus shingles are joined to these prefixes; every shingle carries the
windows that may hold it, so position and length bounds drop what cannot hold the window, and the window at the right
place is compared exactly (64-bit hashes of its words).

Null, empty or short texts on either side give nothing; repeated rows count once; an id may be null and is then kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.shingling import shingle_hashes, word_hashes
from scriptorium.sources.tables import broadcast_if_small, durable, spread

#: Words of a shingle of the prefix filter.
SHINGLE_WORDS = 5
#: Words in a row that make a leak.
SPAN_WORDS = 12
#: Distinct held-out shingles (8 bytes each) up to which they are sent to the scan of the corpus.
SENT_SHINGLES = 2_000_000


def _places(df: DataFrame, key: str, text: str, span: int, shingle: int, wanted: np.ndarray | None) -> DataFrame:
    """(key, prefix, around): each shingle with the `span - shingle + 1` windows that may hold it.

    around[k] is the window that starts at the shingle's place minus k; null hash 0 beyond either end. `wanted` (sorted
    shingle hashes) keeps only these shingles.
    """
    inside = span - shingle + 1
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        void = np.zeros(inside - 1, dtype=np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows, small, around = [], [], []
                for row, value in enumerate(batch.column(1).slice(lo, 1000).to_pylist()):
                    words = word_hashes(value)
                    if len(words) < span:
                        continue
                    prefix = shingle_hashes(words, shingle).view(np.int64)
                    padded = np.concatenate((void, shingle_hashes(words, span), void))
                    held = np.lib.stride_tricks.sliding_window_view(padded, inside)[:, ::-1].view(np.int64)
                    if wanted is not None:
                        at = np.searchsorted(wanted, prefix)
                        keep = wanted[np.minimum(at, len(wanted) - 1)] == prefix if len(wanted) else np.zeros(len(prefix), bool)
                        prefix, held = prefix[keep], held[keep]
                    if len(prefix):
                        rows.append(np.full(len(prefix), lo + row))
                        small.append(prefix)
                        around.append(held)
                if not rows:
                    continue
                keys = batch.column(0).take(pa.array(np.concatenate(rows)))
                held = np.concatenate(around)
                offsets = np.arange(len(held) + 1, dtype=np.int32) * inside
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(held).ravel()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(small)), lists], names=["key", "prefix", "around"])

    return spread(narrow, "key").mapInArrow(run, f"key {kind}, prefix bigint, around array<bigint>")


def leaked_passages(
    corpus: DataFrame, corpus_id: str, corpus_text: str, items: DataFrame, item_id: str, item_texts: list[str],
    *, span: int = SPAN_WORDS, shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """Distinct (corpus_id, item_id) of all documents and items that share `span` consecutive words.

    The shingles of the items are sent to the scan of the corpus only if they are few (counted); otherwise the corpus
    shingles are joined to them by a shuffle. The result is the same.
    """
    texts = F.explode(F.array(*[F.col(c) for c in item_texts]))
    pieces = _places(items.select(F.col(item_id).alias("item"), texts.alias("text")), "item", "text", span, shingle, None)
    windows = durable(
        pieces.select(F.col("key").alias("item"), "prefix", F.posexplode("around").alias("offset", "window")).filter("window <> 0").distinct()
    )
    shingles = windows.select("prefix").distinct()
    few = shingles.limit(SENT_SHINGLES + 1).count() <= SENT_SHINGLES
    wanted = np.sort(shingles.toArrow().column(0).to_numpy()) if few else None
    places = _places(corpus, corpus_id, corpus_text, span, shingle, wanted)
    if wanted is None:
        places = places.join(shingles, "prefix", "left_semi")
    places = durable(places)
    frequency = places.select("key", "prefix").distinct().groupBy("prefix").agg(F.count(F.lit(1)).alias("frequency"))
    # Shingles that no document has end a window's chance: it stands nowhere.
    rarest = (
        windows.join(frequency, "prefix", "left")
        .groupBy("item", "window")
        .agg(F.min_by(F.struct("prefix", "offset", "frequency"), F.struct(F.coalesce("frequency", F.lit(0)), "offset", "prefix")).alias("p"))
        .filter("p.frequency is not null")
        .select("item", "window", "p.prefix", "p.offset")
    )
    hits = places.join(broadcast_if_small(rarest), "prefix").filter(F.get("around", F.col("offset")) == F.col("window"))
    return hits.select(F.col("key").alias(corpus_id), F.col("item").alias(item_id)).distinct()

"""Near-duplicate texts by Golay-code fuzzy hashing (problem 1).

A text is the set of its word shingles. For each of `bands` hash orders the smallest shingles of the set make one
fingerprint segment: the very smallest is the anchor, the next `SEGMENT` ones set bits of a 23-bit vector. The binary
Golay code is perfect: every vector lies within three errors of exactly one codeword. A segment is decoded together
with its 23 neighbours, which gives one or six codeword indices, and two segments with at most two differing bits
always share one of them. A key is (anchor, codeword index). Since the differing shingles of two similar sets are
spread over all segments, by the pigeonhole principle some segments keep at most two errors; pairs meet in their keys
and are verified by their exact similarity. Four bits of each of `SKETCH` anchors travel with a segment, so pairs that
only share a common phrase are dropped where they meet.

Segments are shuffled by their anchor, undecoded; the keys of an anchor are decoded and joined where its segments lie.
Texts with equal shingle sets are one class from the start. An anchor that more than `HOT_ANCHOR` classes share makes no
keys. A class takes two of the `SPARE` further bands for each such anchor among its first `bands`: a pair is then about
as likely to meet as without crowded anchors, even if all of them are common to both. Classes that have too few other
bands for that are joined by the rarest shingles that no similar pair can avoid (a prefix filter), which is exact.

Shingle sets are several times as large as their texts, so none is stored or shuffled but those of the prefix filter:
candidates are verified on their texts. Segments are shuffled in `PARTS` parts, and each step's shuffle files are removed
at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.shingling import mix, shingle_hashes, word_hashes
from scriptorium.sources.tables import broadcast_if_small, durable, release, spread

#: Defaults; a query may state others.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Hash orders of a fingerprint.
BANDS = 24
#: Further bands, for those whose anchors are too common to make keys.
SPARE = 8
#: Anchors of which four bits make the sketch (two 64-bit integers).
SKETCH = 32
#: Shingles that set the bits of a segment.
SEGMENT = 7
#: Classes that share an anchor up to which its keys are joined; beyond it they meet in other bands or rarest shingles.
HOT_ANCHOR = 50_000
#: Parts in which the segments are shuffled, one after another.
PARTS = 3
#: Shingle sets that a task keeps while it verifies pairs.
SETS_AT_ONCE = 5_000
#: Rows and pairs that a task holds at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 2_000_000
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Bits of a vector, the lower ones of a packed segment; the upper 41 are those of its anchor.
VECTOR_BITS = 23


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """Codeword index (12 bits) of every 23-bit vector."""
    words = np.zeros(1, dtype=np.int64)
    for bit in range(12):
        words = np.concatenate((words, words ^ (GENERATOR << bit)))
    units = [1 << i for i in range(23)]
    errors = [0, *units]
    errors += [units[i] ^ units[j] for i in range(23) for j in range(i)]
    errors += [units[i] ^ units[j] ^ units[k] for i in range(23) for j in range(i) for k in range(j)]
    table = np.empty(1 << 23, dtype=np.int16)
    for error in errors:
        table[words ^ error] = np.arange(4096, dtype=np.int16)
    return table


def golay_keys(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of each vector and of its 23 neighbours, each index once a row."""
    table = golay_table()
    near = np.empty((len(vectors), 24), dtype=np.int16)
    near[:, 0] = table[vectors]
    for bit in range(23):
        near[:, bit + 1] = table[vectors ^ (1 << bit)]
    near.sort(axis=1)
    fresh = np.ones(near.shape, dtype=bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, _ = np.nonzero(fresh)
    return rows, near[fresh]


def least_sketch(similarity: float) -> int:
    """Equal anchors (of SKETCH) below which a pair cannot have the similarity: 4.2 standard deviations off."""
    p = similarity + (1 - similarity) / 16
    return max(1, int(SKETCH * p - 4.2 * (SKETCH * p * (1 - p)) ** 0.5))


def _seeds(first: int, count: int) -> np.ndarray:
    return mix(np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit integers for each set, four bits for each of SKETCH smallest hashes."""
    seeds = _seeds(1_000_000, SKETCH)
    least = np.stack([mix(items.view(np.uint64)[None, :] ^ seeds[:, None]).min(axis=1) for items in sets])
    nibbles = (least & np.uint64(15)) << (np.arange(SKETCH, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
    return np.bitwise_or.reduce(nibbles.reshape(len(sets), 2, 16), axis=2).view(np.int64)


def segments(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, 23-bit vector) of every set in every band, as matrices."""
    take = SEGMENT + 1
    seeds = _seeds(0, bands)
    anchors = np.empty((len(sets), bands), dtype=np.uint64)
    vectors = np.zeros((len(sets), bands), dtype=np.int32)
    for row, items in enumerate(sets):
        hashed = mix(items.view(np.uint64)[None, :] ^ seeds[:, None])
        if hashed.shape[1] > take:
            hashed = np.partition(hashed, take - 1, axis=1)[:, :take]
        hashed.sort(axis=1)
        anchors[row] = hashed[:, 0]
        bits = np.int32(1) << (hashed[:, 1:] % np.uint64(23)).astype(np.int32)
        vectors[row] = np.bitwise_or.reduce(bits, axis=1) if bits.shape[1] else 0
    return anchors.view(np.int64), vectors


def _set(text: str, shingle_words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text), shingle_words).view(np.int64))


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def fingerprints(df: DataFrame, key: str, text: str, shingle_words: int, least_words: int, bands: int) -> DataFrame:
    """(member, said, class, n, s0, s1, segments) of each text of at least `least_words` words.

    `said` is a 64-bit digest of the text and `class` one of its set of shingles, n the size of the set, s0 and s1 its
    sketch; `segments` has anchor and vector of each band, packed. Null texts and shorter ones have no row.
    """
    least = max(least_words, shingle_words)
    narrow = df.select(F.col(key).alias("member"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    kind = narrow.schema["member"].dataType.simpleString()
    names = ["member", "said", "class", "n", "s0", "s1", "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                sets, kept = [], []
                for row, value in enumerate(batch.column(1).slice(lo, 2000).to_pylist()):
                    words = word_hashes(value)
                    if len(words) >= least:
                        kept.append(lo + row)
                        sets.append(np.unique(shingle_hashes(words, shingle_words).view(np.int64)))
                if not sets:
                    continue
                anchors, vectors = segments(sets, bands)
                packed = anchors << np.int64(VECTOR_BITS) | vectors
                digests = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
                sketch, at = sketches(sets), pa.array(kept, type=pa.int32())
                columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(digests), pa.array([len(x) for x in sets], pa.int32())]
                columns += [pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), _lists(packed.ravel(), [bands] * len(sets))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    told = spread(narrow, "member").withColumn("said", F.xxhash64("text"))
    return told.mapInArrow(run, f"member {kind}, said bigint, class bigint, n int, s0 bigint, s1 bigint, segments array<bigint>")


def _equal_nibbles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal groups of four bits of two arrays of 64-bit integers."""
    differ = (x ^ y).view(np.uint64)
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    return 16 - np.bitwise_count(differ & np.uint64(0x1111111111111111)).astype(np.int64)


def _met(anchor: np.ndarray, owner: np.ndarray, vector: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Candidate pairs (two columns) of segments sorted by anchor that share a key of their anchor."""
    group = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]]) - 1
    shared = np.bincount(group)[group] > 1
    if not shared.any():
        return
    group, owner, vector, n, sketch = group[shared], owner[shared], vector[shared], n[shared], sketch[shared]
    rows, index = golay_keys(vector)
    keys = group[rows] << 12 | index.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.repeat(np.r_[first[1:], len(keys)], np.diff(np.r_[first, len(keys)]))
    partners = last - np.arange(len(keys)) - 1
    total, least, lo = np.cumsum(partners), least_sketch(similarity), 0
    while lo < len(keys):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
        count = partners[lo:hi]
        left = np.repeat(np.arange(lo, hi), count)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
        a, b = rows[left], rows[right]
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        close = (small >= np.ceil(similarity * large - 1e-9)) & (owner[a] != owner[b])
        a, b = a[close], b[close]
        near = _equal_nibbles(sketch[a, 0], sketch[b, 0]) + _equal_nibbles(sketch[a, 1], sketch[b, 1]) >= least
        x, y = owner[a[near]], owner[b[near]]
        if len(x):
            yield np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        lo = hi


def _anchor(segment: str) -> Column:
    return F.shiftright(segment, VECTOR_BITS)


def _key_pairs(parts: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of segments (segment, class, n, s0, s1) that share a key and whose sketches are near.

    Segments lie sorted by their anchor; a task holds whole anchors, at most HOT_ANCHOR segments more than ROWS_AT_ONCE.
    """

    def pairs(held: list[pa.RecordBatch], end: bool) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        segment, owner, n, s0, s1 = (table.column(i).to_numpy() for i in range(5))
        anchor, vector = segment >> VECTOR_BITS, segment & ((1 << VECTOR_BITS) - 1)
        upto = len(anchor) if end else int(np.searchsorted(anchor, anchor[-1]))
        out = []
        if upto:
            for met in _met(anchor[:upto], owner[:upto], vector[:upto], n[:upto], np.stack((s0[:upto], s1[:upto]), axis=1), similarity):
                out.append(pa.RecordBatch.from_arrays([pa.array(met[:, 0]), pa.array(met[:, 1])], names=["a", "b"]))
        return out, table.slice(upto).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                out, held = pairs(held, False)
                yield from out
        if sum(b.num_rows for b in held):
            yield from pairs(held, True)[0]

    ordered = parts.select("segment", "class", "n", "s0", "s1").repartition(_anchor("segment")).sortWithinPartitions("segment")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def prefix_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of all classes (class, n, set) that may have the similarity: none that has it is left out.

    Shingles are ordered by rarity; a pair of the similarity has one in common among the first n - ceil(similarity n) + 1
    of both, with enough left behind it on both sides. Shingles of one class alone come first; they are counted, not kept.
    """
    parts = []
    for part in range(PARTS):
        said = classes.select("class", "n", F.explode("set").alias("shingle")).filter(F.pmod("shingle", F.lit(PARTS)) == part)
        counts = said.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        parts.append(durable(said.join(counts, "shingle"), tidy=True))
    shared = parts[0]
    for part in parts[1:]:
        shared = shared.unionByName(part)
    own = Window.partitionBy("class")
    ranked = shared.withColumn("at", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "shingle")))
    least = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    keys = durable(ranked.filter(F.col("at") <= F.col("n") - least + 1).select("class", "n", "shingle", "at"), tidy=True)
    release(*parts)
    side = lambda x: keys.select("shingle", F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"))
    common = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9)
    fits = (F.least("na", "nb") >= F.ceil(F.lit(similarity) * F.greatest("na", "nb") - 1e-9)) & (1 + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= common)
    found = durable(side("a").join(side("b"), "shingle").filter("a < b").filter(fits).select("a", "b").distinct(), tidy=True)
    release(keys)
    return found


def chosen_bands(anchors: np.ndarray, crowded: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(bands that make keys, as a mask, rows that have too few of them) of anchors, a row a class; `crowded` is sorted.

    With k crowded anchors among the first `bands` a class takes the first `bands` + k bands that are not crowded.
    """
    free = np.ones(anchors.shape, dtype=bool)
    if len(crowded):
        free = crowded[np.minimum(np.searchsorted(crowded, anchors), len(crowded) - 1)] != anchors
    need = bands + (~free[:, :bands]).sum(axis=1)
    return free & (np.cumsum(free, axis=1) <= need[:, None]), free.sum(axis=1) < need


def _anchors(batch: pa.RecordBatch) -> np.ndarray:
    """Packed segments of a batch (class, n, s0, s1, segments), a row a class."""
    return batch.column(4).flatten().to_numpy().reshape(batch.num_rows, -1)


def _segments(classes: DataFrame, crowded: np.ndarray, bands: int, part: int) -> DataFrame:
    """(segment, class, n, s0, s1) of the segments of one part that make keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = _anchors(batch)
                anchors = packed >> VECTOR_BITS
                rows, columns = np.nonzero(chosen_bands(anchors, crowded, bands)[0] & (anchors % PARTS == part))
                owners = [batch.column(i).take(pa.array(rows)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(packed[rows, columns]), *owners], names=["segment", "class", "n", "s0", "s1"])

    return classes.select("class", "n", "s0", "s1", "segments").mapInArrow(run, "segment bigint, class bigint, n int, s0 bigint, s1 bigint")


def _crowded_classes(classes: DataFrame, crowded: np.ndarray, bands: int) -> DataFrame:
    """(class, said) of the classes that have too few bands without crowded anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                few = pa.array(chosen_bands(_anchors(batch) >> VECTOR_BITS, crowded, bands)[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(few), batch.column(5).filter(few)], names=["class", "said"])

    return classes.select("class", "n", "s0", "s1", "segments", "said").mapInArrow(run, "class bigint, said bigint")


def class_texts(df: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(class, text) of `wanted` (class, said): one text of each class."""
    small = broadcast_if_small(wanted)
    texts = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).withColumn("said", F.xxhash64("text"))
    return texts.join(small, "said").groupBy("said", "class").agg(F.first("text").alias("text")).select("class", "text")


def _sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(class, n, set) of (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = [_set(x, shingle_words) for x in batch.column(1).to_pylist()]
                sizes = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), _lists(np.concatenate(sets), sizes)], names=["class", "n", "set"])

    return texts.mapInArrow(run, "class bigint, n int, `set` array<bigint>")


def candidates(classes: DataFrame, similarity: float, bands: int, hot: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, few) of classes (class, said, n, s0, s1, segments).

    Pairs (a, b) meet in a key. `few` (class, said) has too few bands without crowded anchors, so its pairs are wanted
    from `prefix_pairs`; None if no anchor is crowded.
    """
    hot = HOT_ANCHOR if hot is None else hot
    counts = classes.select(F.explode("segments").alias("segment")).groupBy(_anchor("segment").alias("anchor")).agg(F.count(F.lit(1)).alias("c"))
    # At most one in `hot` of all segments, so few that every task has them all.
    shared = durable(counts.filter(F.col("c") > hot).select("anchor"), tidy=True)
    crowded = np.sort(shared.toArrow().column(0).to_numpy())
    release(shared)
    parts = [durable(_key_pairs(_segments(classes, crowded, bands, part), similarity), tidy=True) for part in range(PARTS)]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    found = durable(pairs.distinct(), tidy=True)
    release(*parts)
    return found, durable(_crowded_classes(classes, crowded, bands)) if len(crowded) else None


def verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of classes (class, text) that have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            alike = np.zeros(batch.num_rows)
            for row, (a, b, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if len(sets) >= SETS_AT_ONCE:
                    sets.clear()
                for owner, value in ((a, x), (b, y)):
                    if owner not in sets:
                        sets[owner] = _set(value, shingle_words)
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                alike[row] = common / (len(sets[a]) + len(sets[b]) - common)
            near = pa.array(alike >= similarity - 1e-12)
            columns = [batch.column(0).filter(near), batch.column(1).filter(near), pa.array(alike).filter(near)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity"])

    side = lambda x: texts.select(F.col("class").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_classes(
    df: DataFrame, key: str, text: str, *, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY,
    least_words: int = 0, bands: int = BANDS, hot: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership is distinct (member, class); links is (a, b, similarity), a < b, of classes.

    Similarity is the number of common shingles divided by the number of distinct shingles of both. Members with equal
    shingle sets share a class and need no link. A null key is a member like any other; empty tables give empty results.
    """
    marks = durable(fingerprints(df, key, text, shingle_words, least_words, bands + SPARE), tidy=True)
    membership = durable(marks.select("member", "class").distinct(), tidy=True)
    classes = durable(marks.groupBy("class").agg(*[F.first(c).alias(c) for c in ("said", "n", "s0", "s1", "segments")]), tidy=True)
    release(marks)
    pairs, few = candidates(classes, similarity, bands, hot)
    named = durable(classes.select("class", "said"))
    release(classes)
    if few is not None:
        held = durable(_sets(class_texts(df, text, few), shingle_words), tidy=True)
        met, rare = pairs, prefix_pairs(held, similarity)
        pairs = durable(met.unionByName(rare).distinct(), tidy=True)
        release(few, held, met, rare)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = durable(named.join(ends, "class", "left_semi"), tidy=True)
    release(named)
    texts = durable(class_texts(df, text, wanted), tidy=True)
    release(wanted)
    links = durable(verified(pairs, texts, shingle_words, similarity), tidy=True)
    release(pairs, texts)
    return membership, links


def member_pairs(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b, of all different members of one class or of two linked classes."""
    m = membership.select("class", "member")
    left, right = m.select(F.col("class").alias("a"), F.col("member").alias("x")), m.select(F.col("class").alias("b"), F.col("member").alias("y"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    inside = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return across.unionByName(inside).filter("x <> y").select(_low("x", "y").alias("a"), _high("x", "y").alias("b")).distinct()


def _low(x: str, y: str) -> Column:
    return F.least(x, y)


def _high(x: str, y: str) -> Column:
    return F.greatest(x, y)

"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Each Arrow batch is split into pre-tokens; the distinct ones become rows of padded integer matrices, bucketed by
length. In every round every row merges its leftmost pair of minimum rank; pair ranks come from an open-addressing
hash table over (left id, right id), and matrices are compacted after each round. A very long row is folded into a matrix
of its own with the minimum of each line, and merged in the same order. Finished words are kept in a bounded
memo per worker, so a word is merged about once per worker.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of the operator.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept in a worker's memo at most; when full it starts again.
MEMO_WORDS = 400_000
#: Bytes of a row beyond which its ranks are folded into a matrix of this width, so that a round looks at one of its rows.
FOLD = 512
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, which is its rank; vectorised open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, _NONE, dtype=np.int32)
        pending_keys, pending_values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)
        slot = self._slot(pending_keys)
        self.probes = 0
        while len(pending_keys):
            self.probes += 1
            free = self.keys[slot] == -1
            at, which = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[which]
            self.keys[at], self.values[at] = pending_keys[chosen], pending_values[chosen]
            rest = np.ones(len(pending_keys), dtype=bool)
            rest[chosen] = False
            pending_keys, pending_values = pending_keys[rest], pending_values[rest]
            slot = (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where the pair does not merge (or a side is padding)."""
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        slot, out = self._slot(keys), np.full(keys.shape, _NONE, dtype=np.int32)
        open_at = np.flatnonzero((left >= 0) & (right >= 0))
        key, at = keys[open_at], slot[open_at]
        for _ in range(self.probes + 1):
            found = self.keys[at]
            hit = found == key
            out[open_at[hit]] = self.values[at[hit]]
            going = ~hit & (found != -1)
            if not going.any():
                break
            open_at, key, at = open_at[going], key[going], (at[going] + 1) & (len(self.keys) - 1)
        return out


class ByteBPE:
    """Encoder over a rank file (`<base64 token> <rank>` a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.table = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.whole = ranks
        self.memo: dict[str, np.ndarray] = {}
        import regex

        self.split = regex.compile(PRE_TOKEN).findall

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of token ids padded with -1 -> the merged ids of each row."""
        rows, done = np.arange(len(ids)), [None] * len(ids)
        rank = self.table.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), dtype=np.int64)
            live = rank[np.arange(len(ids)), at] != _NONE if rank.shape[1] else np.zeros(len(ids), dtype=bool)
            for r, row in zip(rows[~live], ids[~live]):
                done[r] = row[row >= 0]
            ids, rank, rows, at = ids[live], rank[live], rows[live], at[live]
            if not len(ids):
                break
            n, width = ids.shape
            every = np.arange(n)
            ids[every, at] = rank[every, at]
            keep = np.ones((n, width), dtype=bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), dtype=bool)
            keep[every, at] = False
            rank = rank[keep].reshape(n, width - 2)
            for shift in (-1, 0):  # the two pairs that touch the merged token
                k = at + shift
                ok = (k >= 0) & (k < width - 2)
                r, c = every[ok], k[ok]
                rank[r, c] = self.table.ranks(ids[r, c], ids[r, c + 1])
        return done

    def _merge_folded(self, ids: np.ndarray) -> np.ndarray:
        """One long row: its leftmost pair of minimum rank a round, found by the minima of the folded ranks.

        A merged token stays at the place of its left part; the place of its right part is left empty.
        """
        size = len(ids)
        count = -(-size // FOLD)
        rank = np.full(count * FOLD, _NONE, dtype=np.int32)
        rank[: size - 1] = self.table.ranks(ids[:-1], ids[1:])
        folded = rank.reshape(count, FOLD)
        least = folded.min(axis=1)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        while True:
            line = int(least.argmin())
            if least[line] == _NONE:
                return ids[ids >= 0]
            at = line * FOLD + int(folded[line].argmin())
            gone = int(after[at])
            ids[at], ids[gone], rank[gone] = rank[at], -1, _NONE
            right, left = int(after[gone]), int(before[at])
            after[at] = right
            rank[at] = _NONE
            touched = {line, gone // FOLD}
            firsts = []
            if right < size:
                before[right] = at
                firsts.append((at, right))
            if left >= 0:
                firsts.append((left, at))
            if firsts:
                x, y = (np.array(c) for c in zip(*firsts))
                rank[x] = self.table.ranks(ids[x], ids[y])
                touched.update(int(i) // FOLD for i in x)
            for line in touched:
                least[line] = folded[line].min()

    def learn(self, words: list[str]) -> None:
        """Put the ids of `words` into the memo."""
        buckets: dict[int, list[tuple[str, np.ndarray]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            token = self.whole.get(raw)
            if token is not None:
                self.memo[word] = np.array([token], dtype=np.int32)
                continue
            ids = self.byte_id[np.frombuffer(raw, dtype=np.uint8)]
            if len(ids) > FOLD:
                self.memo[word] = self._merge_folded(ids)
            else:
                buckets.setdefault(-(-len(ids) // 8), []).append((word, ids))
        for group in buckets.values():
            for lo in range(0, len(group), 8192):
                part = group[lo : lo + 8192]
                matrix = np.full((len(part), max(len(ids) for _, ids in part)), -1, dtype=np.int32)
                for row, (_, ids) in zip(matrix, part):
                    row[: len(ids)] = ids
                for (word, _), ids in zip(part, self._merge_rows(matrix)):
                    self.memo[word] = ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = set().union(*split) - self.memo.keys() if split else set()
        if len(self.memo) + len(fresh) > MEMO_WORDS:
            self.memo.clear()
            fresh = set().union(*split)
        self.learn(list(fresh))
        memo = self.memo
        parts = [np.concatenate([memo[w] for w in words]) if words else np.empty(0, np.int32) for words in split]
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return offsets, np.concatenate(parts) if parts else np.empty(0, np.int32)


_ENCODERS: dict[str, ByteBPE] = {}


def _encoder(path: str) -> ByteBPE:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


def encode_column(
    df: DataFrame, key: str, text: str = "text", *, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, ids): each row's text as its list of token ids, without special tokens.

    Null or empty text: an empty list. Repeated rows come out as often as they go in; further columns are dropped.
    """
    path = os.path.join(tokenizer_dir, f"{vocabulary}.tiktoken")
    narrow = df.select(F.col(key).alias(key), F.col(text).alias("text"))
    kind = narrow.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, max(1, len(texts)), 2000):
                offsets, ids = encoder.encode(texts[lo : lo + 2000])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 2000), lists], names=[key, "ids"])

    return narrow.mapInArrow(run, f"`{key}` {kind}, ids array<int>")

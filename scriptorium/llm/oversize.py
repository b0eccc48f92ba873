"""Cutting oversized items at natural boundaries by pointer doubling (problem 6).

Every word start of an item is a boundary. Each boundary is joined to its farthest legal successor: the last paragraph,
line or sentence boundary that keeps the piece under the limit, or the last word that does when there is none; the next
piece starts the overlap before that cut. The successor table of all boundaries of a batch is squared (next = next of
next) and the set of cuts reached from the first boundary doubles with it, so all cuts of all items come out in
log2(pieces) array steps.

Null and blank texts give no piece. A text under the limit gives one piece. Repeated rows give their pieces once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.text import NUMBERED_HEADING

TOKEN_FACTOR = 1.3
_NUMBERED = re.compile(NUMBERED_HEADING)
SCHEMA = "item_key string, piece int, char_start int, char_end int, estimate int, sections array<string>, text string"


def most_words(limit: int) -> int:
    """The largest number of words whose estimate does not exceed `limit`."""
    n = max(0, int(limit / TOKEN_FACTOR) - 2)
    while int(TOKEN_FACTOR * (n + 1)) <= limit:
        n += 1
    return n


def _boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and whether a natural boundary lies before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (codes == 32) | (codes == 9) | (codes == 10) | (codes == 13)
    padded = np.concatenate(([True], blank, [True]))
    starts = np.flatnonzero(padded[:-1] & ~padded[1:])
    ends = np.flatnonzero(~padded[:-1] & padded[1:])
    lines = np.concatenate(([0], np.cumsum((codes == 10) | (codes == 13))))
    natural = np.zeros(len(starts), dtype=bool)
    if len(starts) > 1:
        broken = lines[starts[1:]] > lines[ends[:-1]]
        last = ends[:-1] - 1
        closing = np.isin(codes[last], [ord(c) for c in "\"')]”’»"]) & (last > starts[:-1])
        last = np.where(closing, last - 1, last)
        natural[1:] = broken | np.isin(codes[last], [ord(c) for c in ".!?。！？…"])
    return starts, ends, natural


def cut(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text its pieces as (char_start, char_end, first word, word after the last)."""
    width, back = most_words(limit), most_words(overlap)
    if width <= back:
        raise ValueError("the overlap must be smaller than the limit")
    marks = [_boundaries(t) for t in texts]
    counts = np.array([len(s) for s, _, _ in marks])
    first = np.concatenate(([0], np.cumsum(counts)))
    total = first[-1]
    if not total:
        return [[] for _ in texts]
    last_of = np.repeat(first[1:], counts)
    here = np.arange(total)
    natural = np.concatenate([n for _, _, n in marks])
    natural_upto = np.maximum.accumulate(np.where(natural, here, -1))
    farthest = np.minimum(here + width, last_of)
    good = natural_upto[np.minimum(farthest, total - 1)]
    end = np.where(farthest == last_of, last_of, np.where(good > here + back, good, farthest))
    successor = np.where(end == last_of, here, end - back)
    reached = np.zeros(total, dtype=bool)
    front = first[:-1][counts > 0]
    reached[front] = True
    known = front
    while True:
        further = successor[known]
        further = np.unique(further[~reached[further]])
        if not len(further):
            break
        reached[further] = True
        known = np.concatenate((known, further))
        successor = successor[successor]
    cuts = np.flatnonzero(reached)
    owner = np.searchsorted(first, cuts, side="right") - 1
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for at, item in zip(cuts, owner):
        starts, ends, _ = marks[item]
        a, b = int(at - first[item]), int(end[at] - first[item])
        out[item].append((0 if a == 0 else int(starts[a]), len(texts[item]) if b == len(starts) else int(ends[b - 1]), a, b))
    return out


def touched(text: str, sections: list[str] | None, start: int, end: int) -> list[str]:
    """Sorted titles of the sections that the span touches.

    Headings found in the text start their section. What stands before the first heading belongs to the titles of
    `sections` that no heading names. Without `sections` the titles come from numbered headings alone.
    """
    named = {s.strip().casefold(): s for s in sections or [] if s and s.strip()}
    marks: list[tuple[int, str]] = []
    at = 0
    for line in text.split("\n"):
        title = line.strip().rstrip(".:")
        if line and len(line) <= 80:
            numbered = _NUMBERED.match(line)
            key = (numbered[2] if numbered else title).strip().rstrip(".:").casefold()
            if key in named:
                marks.append((at, named[key]))
            elif numbered and not named:
                marks.append((at, numbered[2].strip()))
        at += len(line) + 1
    before = set(named.values()) - {t for _, t in marks}
    first = marks[0][0] if marks else len(text) + 1
    found = set(before) if start < first else set()
    for (a, title), b in zip(marks, [*(m[0] for m in marks[1:]), len(text) + 1]):
        if a < end and start < b:
            found.add(title)
    return sorted(found)


def split_oversized(
    df: DataFrame, key: str, text: str = "text", sections: str | None = None, *, limit: int, overlap: int, with_text: bool = True
) -> DataFrame:
    """The pieces of every row of `df` whose estimate exceeds `limit`: SCHEMA.

    The estimate of a text is the whole part of 1.3 times its words, words being runs without space, tab, line feed and
    carriage return; it is computed natively, and only oversized texts reach Python. Consecutive pieces share the words
    that fit `overlap`. Rows with a null key keep it. `sections` (array<string>) is optional.
    """
    words = F.size(F.filter(F.split(F.col(text), "[ \t\n\r]+"), lambda w: w != ""))
    narrow = (
        df.select(
            F.col(key).cast("string").alias("item_key"),
            F.col(text).alias("text"),
            (F.col(sections) if sections else F.lit(None)).cast("array<string>").alias("sections"),
        )
        .filter(F.col("text").isNotNull() & (F.floor(words * F.lit(TOKEN_FACTOR)) > limit))
        .dropDuplicates(["item_key", "text"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keys, texts, titles = (part.column(i).to_pylist() for i in range(3))
                rows = []
                for k, t, s, pieces in zip(keys, texts, titles, cut(texts, limit, overlap)):
                    for number, (a, b, x, y) in enumerate(pieces):
                        said = touched(t, s, a, b) if sections else None
                        rows.append((k, number, a, b, int(TOKEN_FACTOR * (y - x)), said, t[a:b] if with_text else None))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, type=kind)
                        for c, kind in zip(
                            zip(*rows) if rows else [[]] * 7,
                            [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()],
                        )
                    ],
                    names=["item_key", "piece", "char_start", "char_end", "estimate", "sections", "text"],
                )

    return narrow.mapInArrow(run, SCHEMA)

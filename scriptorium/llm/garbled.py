"""Text that was decoded with the wrong character encoding (problem 9).

A hidden Markov model labels the characters of a text: one clean state and one state for each encoding pair (the
encoding the bytes had, the encoding they were read in). The clean state emits a character by a class-bigram model
trained on character counts of the whole corpus; the state of a pair emits what the wrong decoding makes of characters
that the clean model would have emitted. ASCII is the same in all states. Each span labelled with a pair gets the inverse
transform of its state; spans that were garbled twice are labelled and inverted again.

Null and empty texts are never found. A replacement character (U+FFFD) means that something was lost: the text is found,
its original is null.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.tables import spread

#: Fixed values: (encoding of the bytes, encoding they were read in).
PAIRS = [
    ("utf_8", "cp1252"), ("utf_8", "latin_1"), ("utf_8", "cp1250"), ("utf_8", "cp1251"), ("utf_8", "cp437"), ("utf_8", "cp850"),
    ("utf_8", "mac_roman"), ("utf_8", "iso8859_15"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1252", "mac_roman"),
    ("cp1252", "cp850"), ("cp1252", "cp437"),
]
#: Log probabilities of entering and of leaving a garbled state at a non-ASCII character.
ENTER, LEAVE = math.log(1e-3), math.log(0.05)
STAY_CLEAN, STAY_GARBLED = math.log(1 - 1e-2), math.log(0.95)
LOST = "�"
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_IMPOSSIBLE = -1e9


@lru_cache(maxsize=None)
def _class(char: str) -> str:
    """A coarse class: script, case and kind."""
    code = ord(char)
    if code < 128:
        return "a" if char.islower() else "A" if char.isupper() else "0" if char.isdigit() else " " if char.isspace() else "."
    category = unicodedata.category(char)
    if category[0] == "C":
        return "control"
    block = code >> 7 if code < 0x600 else code >> 8
    if category[0] == "L":
        script = "latin" if code < 0x250 else "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else f"b{block}"
        rare = "-ext" if script == "latin" and code >= 0x100 else ""
        return f"{script}{rare}-{'u' if category == 'Lu' else 'l'}"
    return f"{category[0]}{block}"


_KINDS = ["a", "A", "0", " ", "."]
_ASCII_KIND = np.array([_KINDS.index(_class(chr(i))) for i in range(128)], dtype=np.int64)


@lru_cache(maxsize=None)
def _bytes(read_in: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; undefined bytes of Windows encodings read as C1 controls."""
    table = {}
    for byte in range(128, 256):
        try:
            table[bytes([byte]).decode(read_in)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    return table


@lru_cache(maxsize=None)
def _unit_pattern(read_in: str) -> re.Pattern:
    """Sequences that are the characters of one multi-byte UTF-8 code read in `read_in`."""
    table = _bytes(read_in)
    some = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")


def _decode(unit: str, pair: tuple[str, str]) -> str | None:
    table = _bytes(pair[1])
    try:
        char = bytes(table[c] for c in unit).decode(pair[0])
    except (KeyError, UnicodeDecodeError):
        return None
    return char if len(char) == 1 and unicodedata.category(char) not in ("Cn", "Co", "Cs") else None


@lru_cache(maxsize=None)
def _singles(pair: tuple[str, str]) -> dict[str, str]:
    """Garbled character -> original of a pair of single-byte encodings; equal ones are left out."""
    found = {c: _decode(c, pair) for c in _bytes(pair[1])}
    return {c: o for c, o in found.items() if o is not None and ord(o) > 127 and o != c}


def units(text: str, pair: tuple[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, original character) of all parts of `text` that the pair may have garbled."""
    if pair[0] == "utf_8":
        for m in _unit_pattern(pair[1]).finditer(text):
            if (char := _decode(m[0], pair)) is not None:
                yield m.start(), m.end(), char
    else:
        single = _singles(pair)
        for m in _NON_ASCII.finditer(text):
            if (char := single.get(m[0])) is not None:
                yield m.start(), m.end(), char


def count_clean(texts: list[str | None]) -> Counter:
    """Counts of ("c", character, "") and ("t", class before, class) around non-ASCII characters.

    What a UTF-8 pair may have garbled is left out, so the counts describe clean text even in a corpus that is not.
    """
    out: Counter = Counter()
    wide = [p for p in PAIRS if p[0] == "utf_8"]
    for text in texts:
        if not text or text.isascii():
            continue
        masked = set()
        for pair in wide:
            for a, b, _ in units(text, pair):
                masked.update(range(a, b))
        for m in _NON_ASCII.finditer(text):
            i = m.start()
            if i in masked or m[0] == LOST:
                continue
            out["c", m[0], ""] += 1
            before = text[i - 1] if i else " "
            if i - 1 not in masked:
                out["t", _class(before), _class(m[0])] += 1
        ascii_kinds = np.bincount(_ASCII_KIND[np.frombuffer(text.encode("ascii", "ignore"), dtype=np.uint8)], minlength=len(_KINDS))
        for kind, n in zip(_KINDS, ascii_kinds.tolist()):
            out["n", kind, ""] += n
    return out


class Model:
    """Clean emissions and the labelling of texts."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.chars = {a: n for (kind, a, _), n in counts.items() if kind == "c"}
        self.of_class: Counter = Counter()
        for char, n in self.chars.items():
            self.of_class[_class(char)] += n
        self.moves = {(a, b): n for (kind, a, b), n in counts.items() if kind == "t"}
        self.before: Counter = Counter()
        for char, n in self.chars.items():
            self.before[_class(char)] += n
        for (kind, a, _), n in counts.items():
            if kind == "n":
                self.before[a] += n
        self.total = sum(self.before.values()) + 1
        self.memo: dict[tuple[str, str], float] = {}
        self.pairs: dict[str, float] = {}
        self.gains: list[dict[str, float]] = [{} for _ in PAIRS]

    def emit(self, before: str, char: str) -> float:
        """Log probability of a non-ASCII character after another one in clean text."""
        key = (_class(before), char)
        found = self.memo.get(key)
        if found is None:
            kind = _class(char)
            prior = (self.of_class[kind] + 0.1) / (self.total + 10)
            if kind == "control":
                prior *= 1e-3
            move = (self.moves.get((key[0], kind), 0) + 5 * prior) / (self.before[key[0]] + 5)
            found = math.log(move) + math.log((self.chars.get(char, 0) + 0.05) / (self.of_class[kind] + 0.05 * 200))
            self.memo[key] = found
        return found

    def clean(self, two: str) -> float:
        """Clean emission of the second of two neighbouring characters."""
        found = self.pairs.get(two)
        if found is None:
            found = self.pairs[two] = math.log(1e-12) if two[1] == LOST else self.emit(two[0], two[1])
        return found

    def single(self, number: int, two: str) -> float:
        """Emission of the second of two neighbouring characters in the state of a pair of single-byte encodings."""
        found = self.gains[number].get(two)
        if found is None:
            originals = _singles(PAIRS[number])
            char = originals.get(two[1])
            found = _IMPOSSIBLE if char is None else self.emit(originals.get(two[0], two[0]), char)
            self.gains[number][two] = found
        return found

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, pair) of the garbled spans by Viterbi's path; pair len(PAIRS) is a loss.

        A state whose best stretch gains less over the clean state than entering costs is on no best path and is left out.
        """
        at = [m.start() for m in _NON_ASCII.finditer(text)]
        if not at:
            return []
        twos = [text[i - 1 : i + 1] if i else " " + text[0] for i in at]
        clean = [self.clean(two) for two in twos]
        place: dict[int, int] = {}
        states = []
        for number, pair in enumerate(PAIRS):
            if pair[0] != "utf_8":
                emission = [self.single(number, two) for two in twos]
            else:
                if _unit_pattern(pair[1]).search(text) is None:
                    continue
                place = place or {i: k for k, i in enumerate(at)}
                emission = [_IMPOSSIBLE] * len(at)
                last_end, last_char = -1, ""
                for a, b, char in units(text, pair):
                    if ord(char) < 128:
                        continue
                    before = last_char if a == last_end else text[a - 1] if a else " "
                    value = self.emit(before, char) / (b - a)
                    for i in range(a, b):
                        emission[place[i]] = value
                    last_end, last_char = b, char
            best = run = 0.0
            for e, c in zip(emission, clean):
                run += e - c
                if run < 0:
                    run = 0.0
                elif run > best:
                    best = run
            if best + ENTER > 0:
                states.append((number, emission))
        if LOST in text:
            states.append((len(PAIRS), [math.log(0.5) if text[i] == LOST else _IMPOSSIBLE for i in at]))
        if not states:
            return []
        scores, came = [0.0] + [ENTER] * len(states), []
        for k in range(len(at)):
            base, best_from, best = scores[0] + STAY_CLEAN, 0, scores[0] + STAY_CLEAN
            fresh, back = [0.0], [0]
            for s, (_, emission) in enumerate(states, 1):
                if scores[s] + LEAVE > best:
                    best, best_from = scores[s] + LEAVE, s
                stay, enter = scores[s] + STAY_GARBLED, base + ENTER
                back.append(s if stay >= enter else 0)
                fresh.append(max(stay, enter) + emission[k])
            fresh[0], back[0] = best + clean[k], best_from
            scores = fresh
            came.append(back)
        state = max(range(len(scores)), key=scores.__getitem__)
        labels = [0] * len(at)
        for k in range(len(at) - 1, -1, -1):
            labels[k] = state
            state = came[k][state]
        found: list[tuple[int, int, int]] = []
        for i, label in zip(at, labels):
            if label:
                number = states[label - 1][0]
                if found and found[-1][2] == number and text[found[-1][1] : i].isascii():
                    found[-1] = (found[-1][0], i + 1, number)
                else:
                    found.append((i, i + 1, number))
        return found

    def restore(self, text: str, rounds: int = 3) -> tuple[bool, str | None]:
        """Whether the text is garbled, and its original where nothing was lost."""
        hit, lost = False, False
        for _ in range(rounds):
            spans = self.spans(text)
            if not spans:
                break
            hit, parts, end = True, [], 0
            for a, b, number in spans:
                parts.append(text[end:a])
                piece = text[a:b]
                if number == len(PAIRS):
                    lost = True
                else:
                    done, out = 0, []
                    for x, y, char in units(piece, PAIRS[number]):
                        out += [piece[done:x], char]
                        done = y
                    piece = "".join([*out, piece[done:]])
                parts.append(piece)
                end = b
            fixed = "".join([*parts, text[end:]])
            if fixed == text:
                break
            text = fixed
        return hit, None if lost or not hit else text


def find_garbled(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, garbled, original): rows whose text has garbled spans; original is null where something was lost.

    The column is read twice, once to count and once to label, so no text is copied. The model's counts cover the whole
    column; they are bounded by the alphabet (classes and characters), not by rows.
    Repeated rows come out as often as they go in.
    """
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    narrow = spread(narrow, "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(count_clean(batch.column(1).to_pylist()))
        if total:
            (kind, a, b), n = zip(*total), list(total.values())
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(n, pa.int64())], names=["k", "a", "b", "n"])

    counts = narrow.mapInArrow(count, "k string, a string, b string, n bigint").groupBy("k", "a", "b").agg(F.sum("n").alias("n"))
    table = {(r.k, r.a, r.b): r.n for r in counts.collect()}
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(table)
        for batch in batches:
            rows, originals = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                hit, original = model.restore(value)
                if hit:
                    rows.append(row)
                    originals.append(original)
            at = pa.array(rows, type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(originals, pa.string())], names=["key", "garbled", "original"])

    return narrow.mapInArrow(run, f"key {kind}, garbled string, original string").withColumnRenamed("key", key)

"""Typed values mapped to entries of a canonical list (problem 2).

All spellings of the reference entries (their own, rotations of their words, a word cut short, initials, listed aliases)
are paths of one trie. A value walks the trie with a compiled Levenshtein automaton (swapped neighbours count as one
edit): its states do not depend on the value, so each transition (state, where the next letter stands in the value) is
worked out once in a worker and is a look-up from then on; dead states prune their subtree. The bound depends on the
length. Entries with other numbers than the value are never returned. A value that no edit explains may be a
contraction: inner letters left out, first and last ones kept.

Every distinct value is matched once. Lists of more than `ENTRIES_A_TRIE` entries are cut into blocks, each with a trie
of its own that all values walk, and the best of all blocks is taken, so the result does not depend on the block size.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from scriptorium.functions.lexicon import METRIC_ALIASES, UNITS
from scriptorium.llm.canonical import canonical
from scriptorium.sources.tables import broadcast_if_small, durable

#: Entries of one trie; longer lists take several.
ENTRIES_A_TRIE = 50_000
#: Words added to a name without changing it.
ADDED_WORDS = ["dataset", "data set", "corpus", "benchmark", "collection", "model", "system", "approach", "baseline", "method"]
#: Letters of a spelling that a contraction keeps at least, as a share, and its fewest letters.
CONTRACTION_SHARE, CONTRACTION_LETTERS = 0.6, 5
#: Edits of the longest spellings; contractions come after them.
MOST_EDITS = 3
_BRACKETS = re.compile(r"\s*(\([^()]*\)|\[[^\[\]]*\])")
_WORD = re.compile(r"[^\W_]+")
_NUMBERS = re.compile(r"\d+")
_ADDED = sorted((w.replace(" ", "") for w in ADDED_WORDS), key=len, reverse=True)
#: (stage, distance, rank, entry): a lower one is the better reading of a value.
Match = tuple[int, int, int, int]


def bound(length: int) -> int:
    """Edits allowed against a spelling of `length` letters and digits."""
    return 0 if length <= 4 else 1 if length <= 6 else 2 if length <= 13 else MOST_EDITS


def plain(text: str) -> str:
    """The squashed text without articles before and added words after it, as often as they stand there."""
    words = [w.casefold() for w in _WORD.findall(text)]
    while len(words) > 1 and words[0] == "the":
        words = words[1:]
    while len(words) > 1:
        if words[-1] in _ADDED or _one_off(words[-1]):
            words = words[:-1]
        elif len(words) > 2 and words[-2:] == ["data", "set"]:
            words = words[:-2]
        else:
            break
    word = "".join(words)
    while word.startswith("the") and len(word) > 6:
        word = word[3:]
    while tail := next((t for t in _ADDED if word.endswith(t) and len(word) > len(t)), None):
        word = word[: -len(tail)]
    return word


def _one_off(word: str) -> bool:
    """Whether the word is a misspelt added word of five letters or more."""
    return any(len(t) >= 5 and abs(len(t) - len(word)) <= 1 and sum((Counter(t) - Counter(word)).values()) <= 1
               and sum((Counter(word) - Counter(t)).values()) <= 1 and t[0] == word[0] for t in _ADDED)


def squash(text: str) -> str:
    """Letters and digits in lower case."""
    return "".join(_WORD.findall(text.casefold()))


class Automaton:
    """Levenshtein automaton of one bound for every word: states and transitions are worked out when first met.

    A state is a set of positions (letters of the word read, edits, whether a swap is open), counted from its least
    position. What follows depends on the next letter only by the places where it stands in the letters ahead.
    """

    def __init__(self, most: int):
        self.most, self.window = most, 2 * most + 2
        self.states: list[tuple[tuple[int, int, bool], ...]] = [((0, 0, False),)]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.ends: dict[tuple[int, int], int] = {}

    def step(self, state: int, ahead: int, left: int) -> tuple[int, int]:
        """(state, letters the base moves on) after a letter that stands at the bits of `ahead`; state -1 is dead."""
        key = (state, ahead, left)
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self._step(*key)
        return found

    def _step(self, state: int, ahead: int, left: int) -> tuple[int, int]:
        out: set[tuple[int, int, bool]] = set()
        for at, edits, swap in self.states[state]:
            rest, said = left - at, ahead >> at
            if swap:
                if said & 1 and rest > 0:
                    out.add((at + 2, edits, False))
            elif said & 1 and rest > 0:
                out.add((at + 1, edits, False))
            elif edits < self.most:
                out.add((at, edits + 1, False))
                if rest > 0:
                    out.add((at + 1, edits + 1, False))
                    for gone in range(1, min(self.most - edits, rest - 1) + 1):
                        if said >> gone & 1:
                            out.add((at + gone + 1, edits + gone, False))
                            break
                if rest > 1 and said & 2:
                    out.add((at, edits + 1, True))
        kept = sorted(p for p in out if not any(q != p and not q[2] and abs(p[0] + p[2] - q[0]) <= p[1] - q[1] - p[2] for q in out))
        if not kept:
            return -1, 0
        base = kept[0][0]
        fresh = tuple((at - base, edits, swap) for at, edits, swap in kept)
        number = self.numbers.setdefault(fresh, len(self.states))
        if number == len(self.states):
            self.states.append(fresh)
        return number, base

    def end(self, state: int, left: int) -> int:
        """Edits in all if the spelling ends here and `left` letters of the word remain; more than the bound is none."""
        key = (state, min(left, self.window))
        found = self.ends.get(key)
        if found is None:
            found = self.ends[key] = min((edits + abs(left - at) if left >= at else self.most + 1 for at, edits, swap in self.states[state] if not swap), default=self.most + 1)
        return found


_AUTOMATA = {most: Automaton(most) for most in range(1, MOST_EDITS + 1)}


class Trie:
    """Spellings with the entries they stand for."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str, entry: int, rank: int) -> None:
        """A spelling of `entry`; a lower rank wins among equally near ones."""
        node = self.root
        for char in spelling:
            node = node.setdefault(char, {})
        node.setdefault("", set()).add((rank, entry))

    def exact(self, word: str) -> set[tuple[int, int]]:
        node = self.root
        for char in word:
            node = node.get(char)
            if node is None:
                return set()
        return node.get("", set())

    def search(self, word: str, most: int) -> list[tuple[int, int, int]]:
        """(distance, rank, entry) of all spellings within `most` edits of `word` and within their own bound."""
        automaton, size = _AUTOMATA[most], len(word)
        steps, window = automaton.steps, automaton.window
        wide = (1 << window) - 1
        places: dict[str, int] = {}
        for i, char in enumerate(word):
            places[char] = places.get(char, 0) | 1 << i
        found: list[tuple[int, int, int]] = []
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, state, base, depth = stack.pop()
            left = size - base
            near = left if left < window else window
            for char, child in node.items():
                if char == "":
                    distance = automaton.end(state, left)
                    if distance <= min(most, bound(depth)):
                        found += [(distance, rank, entry) for rank, entry in child]
                    continue
                key = (state, places.get(char, 0) >> base & wide, near)
                step = steps.get(key) or automaton.step(*key)
                if step[0] >= 0:
                    stack.append((child, step[0], base + step[1], depth + 1))
        return found

    def contractions(self, word: str) -> list[tuple[int, int, int]]:
        """(letters left out, rank, entry) of all spellings that `word` is a contraction of."""
        if len(word) < CONTRACTION_LETTERS or word[0] not in self.root:
            return []
        most = int(len(word) / CONTRACTION_SHARE) - len(word)
        found: list[tuple[int, int, int]] = []
        stack = [(self.root[word[0]], 1, 0, word[0])]
        while stack:
            node, at, gone, last = stack.pop()
            for char, child in node.items():
                if char == "":
                    if at == len(word) and last == word[-1] and gone:
                        found += [(gone, rank, entry) for rank, entry in child]
                elif at < len(word) and char == word[at]:
                    stack.append((child, at + 1, gone, char))
                elif gone < most:
                    stack.append((child, at, gone + 1, char))
        return found


class Matcher:
    """Maps typed values of one field to its entries."""

    def __init__(self, entries: list[tuple[int, str]], aliases: dict[str, list[str]] | None = None, units: set[str] | None = None):
        self.trie, self.numbers = Trie(), {}
        self.raw_units = units or set()
        for entry, name in entries:
            words = _WORD.findall(name.casefold())
            self.numbers[entry] = _NUMBERS.findall(name)
            self.trie.add("".join(words), entry, 0)
            for alias in (aliases or {}).get(name, []):
                self.trie.add(squash(alias), entry, 1)
            if aliases is not None or len(words) == 1:
                continue
            for turn in ([*words[1:], words[0]], [words[-1], *words[:-1]]):
                self.trie.add("".join(turn), entry, 2)
            for i, word in enumerate(words):
                for size in range(3, min(6, len(word))):
                    self.trie.add("".join([*words[:i], word[:size], *words[i + 1 :]]), entry, 3)
            text = [w for w in words if not _NUMBERS.search(w)]
            digits = "".join(w for w in words if _NUMBERS.search(w))
            if len(text) + bool(digits) >= 2:
                self.trie.add("".join(w[0] for w in text) + digits, entry, 4)

    def forms(self, value: str) -> list[str]:
        """Readings of the value, the fullest first."""
        text = canonical(value).strip()
        out = [text, _BRACKETS.sub(" ", text)]
        if self.raw_units:
            for sign in (",", " - ", " in ", "(", "["):
                head, found, tail = text.rpartition(sign)
                if found and tail.strip(" )]") in self.raw_units:
                    out.append(head)
                    out.append(_BRACKETS.sub(" ", head))
        forms = [squash(x) for x in out] + [plain(x) for x in out]
        return [w for w in dict.fromkeys(forms) if w]

    def match(self, value: str) -> int:
        """The entry that the value denotes, or -1."""
        best = self.best(value)
        return best[3] if best else -1

    def best(self, value: str) -> Match | None:
        """The best reading of the value, ties to the lowest entry; None if it denotes none.

        Stages: an equal spelling, one edit, two, three, a contraction.
        """
        forms = self.forms(value)
        for number, form in enumerate(forms):
            if hits := self._same_numbers(form, [(number, *h) for h in self.trie.exact(form)]):
                return 0, *min(hits)
        # One edit more at a time: most misspellings have one, and the nearest spelling is wanted.
        for most in range(1, MOST_EDITS + 1):
            hits = []
            for form in forms:
                if most <= bound(len(form) + 2):
                    hits += self._same_numbers(form, [h for h in self.trie.search(form, most) if h[1] < 4])
            if hits:
                return most, *min(hits)
        hits = [h for form in forms for h in self._same_numbers(form, self.trie.contractions(form)) if h[1] < 4]
        return (MOST_EDITS + 1, *min(hits)) if hits else None

    def near(self, value: str) -> list[tuple[int, int]]:
        """(entry, distance) of all entries within the length-dependent distance of any reading of the value."""
        found: dict[int, int] = {}
        for form in self.forms(value):
            hits = [(0, *h) for h in self.trie.exact(form)] + self.trie.search(form, MOST_EDITS)
            for distance, _, entry in self._same_numbers(form, hits):
                if distance <= bound(len(form) + 2):
                    found[entry] = min(found.get(entry, distance), distance)
        return sorted(found.items())

    def _same_numbers(self, form: str, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        numbers = _NUMBERS.findall(form)
        return [h for h in hits if self.numbers[h[2]] == numbers]


_MATCHERS: dict[str, dict[str, Matcher]] = {}


def _matchers(name: str, by_field: dict[str, list[tuple[int, str]]]) -> dict[str, Matcher]:
    """The matchers of one block of entries, built once in a worker; a worker keeps those of one block."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        units = {s for groups in UNITS.values() for group in groups.values() for s in group}
        _MATCHERS[name] = {f: Matcher(e, METRIC_ALIASES, units) if f == "metric" else Matcher(e) for f, e in by_field.items()}
    return _MATCHERS[name]


def _blocks(terms: DataFrame, size: int) -> Iterator[tuple[str, dict[str, list[tuple[int, str]]]]]:
    """(name, field -> entries) of blocks of about `size` entries; only one block is on the driver at a time."""
    entries = terms.select("term_id", "field", "canonical").filter("canonical is not null").distinct()
    count = max(1, -(-entries.count() // size))
    for number in range(count):
        rows = entries.filter(F.pmod(F.xxhash64("term_id", "canonical"), F.lit(count)) == number).collect() if count > 1 else entries.collect()
        by_field: dict[str, list[tuple[int, str]]] = {}
        for r in sorted(rows, key=lambda r: (r.field, r.term_id, r.canonical)):
            by_field.setdefault(r.field, []).append((r.term_id, r.canonical))
        yield hashlib.sha1(repr(sorted(by_field.items())).encode()).hexdigest(), by_field


def typed_values(claims: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """(key, field, value): values that are neither null nor blank nor byte-equal to an entry of their field."""
    narrow = claims.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("said"))
    said = narrow.select("key", "said.field", "said.value").filter(F.col("value").isNotNull() & ~F.col("value").rlike(r"(?U)^\s*$"))
    equal = broadcast_if_small(terms.select("field", F.col("canonical").alias("value")).distinct())
    return said.join(equal, ["field", "value"], "left_anti")


def match_values(values: DataFrame, terms: DataFrame, *, entries_a_trie: int | None = None) -> DataFrame:
    """(field, value, term_id): each distinct (field, value) with its best entry, -1 for none; ties go to the lowest id."""
    cores = values.sparkSession.sparkContext.defaultParallelism
    distinct = durable(values.select("field", "value").distinct().repartition(4 * cores))
    schema = "field string, value string, stage int, distance int, rank int, term_id int"

    def run_with(name: str, by_field: dict[str, list[tuple[int, str]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(name, by_field)
            for batch in batches:
                rows = []
                for field, value in zip(*(c.to_pylist() for c in batch.columns)):
                    best = matchers[field].best(value) if field in matchers else None
                    rows.append((field, value, *(best or (MOST_EDITS + 2, 0, 0, -1))))
                kinds = [pa.string(), pa.string(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["field", "value", "stage", "distance", "rank", "term_id"])

        return run

    parts = []
    for name, by_field in _blocks(terms, entries_a_trie or ENTRIES_A_TRIE):
        part = distinct.mapInArrow(run_with(name, by_field), schema)
        parts.append(part)
        if len(parts) == 2:  # more than one block: each is written, so that its entries leave the driver
            parts = [durable(parts[0]), durable(part)]
        elif len(parts) > 2:
            parts[-1] = durable(part)
    if len(parts) == 1:
        return parts[0].select("field", "value", "term_id")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct("stage", "distance", "rank", "term_id"))
    return found.groupBy("field", "value").agg(best.alias("best")).select("field", "value", F.col("best.term_id").alias("term_id"))


def map_to_terms(claims: DataFrame, key: str, fields: list[str], terms: DataFrame, *, entries_a_trie: int | None = None) -> DataFrame:
    """(key, field, term_id): each claim's value of each field as its entry of `terms`, -1 for none.

    `terms` has term_id, field, canonical, in any number. A value that is null, blank or byte-equal to an entry has no
    row; a null key is kept; repeated claims give one row; ties between entries go to the lowest term_id. Only distinct
    values are matched; their entries are joined back by broadcast where they are few bytes (measured), else by a
    shuffle in which AQE splits a value that many claims share.
    """
    typed = typed_values(claims, key, fields, terms)
    matched = broadcast_if_small(match_values(typed, terms, entries_a_trie=entries_a_trie))
    return typed.join(matched, ["field", "value"]).select(F.col("key").alias(key), "field", F.col("term_id").cast(IntegerType()).alias("term_id")).distinct()


def near_terms(claims: DataFrame, key: str, fields: list[str], terms: DataFrame) -> DataFrame:
    """(field, value, term_id, distance): all entries within the length-dependent distance of each distinct typed value."""
    cores = claims.sparkSession.sparkContext.defaultParallelism
    distinct = durable(typed_values(claims, key, fields, terms).select("field", "value").distinct().repartition(4 * cores))
    schema = "field string, value string, term_id int, distance int"

    def run_with(name: str, by_field: dict[str, list[tuple[int, str]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(name, by_field)
            for batch in batches:
                pairs = zip(*(c.to_pylist() for c in batch.columns))
                rows = [(field, value, *near) for field, value in pairs if field in matchers for near in matchers[field].near(value)]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["field", "value", "term_id", "distance"])

        return run

    found = None
    for name, by_field in _blocks(terms, ENTRIES_A_TRIE):
        part = durable(distinct.mapInArrow(run_with(name, by_field), schema))
        found = part if found is None else found.unionByName(part)
    return found

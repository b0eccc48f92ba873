"""Spellings of names typed by people, linked by the person or organisation they name (problem 3).

Every distinct string is read once: its consistent form, titles removed, accents folded, then for a person a surname
and a given name (full, cut short or an initial), for an organisation its proper name and its generic words. Strings with
equal readings are one form. Suffix blocking finds the forms to compare: every suffix of a field that is long enough is
indexed by its head, and the head is as long as a common block of two values of these lengths has to be, so no pair within
the ratio is lost. Heads carry lengths, places and letters, which drop chance meetings before any text is compared. A
head that more than `COMMON` values share is no block of its own: it is refined by the other field and only forms whose
other fields are near meet in it; none is discarded. Pairs are kept by the ratio of their longest common subsequences.

Of its links a form keeps the one to its nearest more frequent form. They are closed to components, together with the rows that give an alias to a name. Forms that name no one alone (an
initial, a cut given name, a proper name or code without generic words) never link others: each joins the entity that
most rows give it, else, for persons, the nearest that fits, the most frequent one if several do.

Null, blank and collective strings ("et al.") name nobody and have no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scriptorium.llm.canonical import canonical
from scriptorium.operators.components import connected_components
from scriptorium.sources.tables import durable

#: Letters at the beginning or end that the surname of an initial shares with an entity's.
MIN_SUFFIX = 4
#: Values that share a suffix head up to which it is a block of its own; beyond that the other field refines it.
COMMON = 2000
#: Least ratios of the longest common subsequence of the names (surnames, places) and of the second field.
RATIO_NAME, RATIO_SECOND = 0.85, 0.75
#: Titles before a name.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "jr", "sr"}
#: Particles before a surname.
PARTICLES = {"de", "van", "von", "der", "den", "da", "di", "del", "della", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "dos", "du"}
#: Collective remarks.
COLLECTIVE = re.compile(r"\b(et al|and others|others|team|consortium|collaboration|collaborators|group|anonymous|authors?|unknown|various|n/a|contributors|colleagues|members|community|project|the)\b", re.I)
#: Short forms of given names.
NICKNAMES = {
    "alexander": ["alex", "al", "sandy", "sasha", "xander"], "andrew": ["andy", "drew"], "anthony": ["tony"],
    "benjamin": ["ben", "benny", "benji"], "catherine": ["cathy"], "charles": ["charlie", "chuck"],
    "christopher": ["chris", "kit", "topher"], "daniel": ["dan", "danny"], "david": ["dave", "davy"], "deborah": ["debbie", "deb"],
    "dmitri": ["dima", "mitya"], "dorothy": ["dot", "dottie"], "edward": ["ed", "eddie", "ned"],
    "elizabeth": ["liz", "beth", "betty", "lizzie", "eliza", "betsy"], "frederick": ["fred", "freddie", "freddy"],
    "gregory": ["greg"], "gustav": ["gus"], "henry": ["harry", "hank"], "jacob": ["jake"],
    "james": ["jim", "jimmy", "jamie"], "jennifer": ["jen", "jenny", "jenn"], "john": ["jack", "johnny"],
    "jonathan": ["jon", "jonny", "nathan"], "joseph": ["joe", "joey"], "joshua": ["josh"],
    "katherine": ["kate", "kathy", "katie", "kat", "kitty", "kay"], "kenneth": ["ken"], "lawrence": ["larry", "laurie", "lars"],
    "margaret": ["maggie", "meg", "peggy", "marge", "greta", "peg"], "matthew": ["matt", "matty"], "michael": ["mike", "mick", "mickey", "mikey"],
    "nicholas": ["nick", "nicky"], "patricia": ["pat", "patty", "trish"], "peter": ["pete"], "philip": ["phil"],
    "rebecca": ["becky", "becca", "reba"], "richard": ["rick", "dick", "rich", "ricky", "richie"],
    "robert": ["bob", "rob", "bobby", "robbie", "bert"], "ronald": ["ron"], "samuel": ["sam", "sammy"], "stephen": ["steve", "stevie", "steph"],
    "susan": ["sue", "susie", "suzy"], "theodore": ["theo", "teddy", "ted"], "thomas": ["tom", "tommy"], "timothy": ["tim", "timmy"],
    "victoria": ["vicky", "vicki", "tori", "vic"], "vikram": ["vik"], "william": ["will", "bill", "billy", "willy", "liam"],
    "zachary": ["zach", "zack"],
}
_FORMAL: dict[str, list[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short:
        _FORMAL.setdefault(_s, []).append(_formal)
#: Generic words of organisations' names.
GENERIC = [
    "academy", "agency", "analytics", "association", "bureau", "center", "centre", "clinic", "college", "council", "department",
    "engineering", "faculty", "foundation", "hospital", "institute", "international", "laboratory", "library", "medicine", "ministry",
    "museum", "national", "observatory", "polytechnic", "research", "royal", "school", "science", "society", "software", "state",
    "systems", "technology", "university",
]
#: Other forms of generic words.
GENERIC_FORMS = {
    "u": "university", "univ": "university", "universitat": "university", "universite": "university", "universidad": "university",
    "universita": "university", "res": "research", "laboratories": "laboratory", "lab": "laboratory", "labs": "laboratory",
    "inst": "institute", "institut": "institute", "tech": "technology", "technol": "technology", "technologies": "technology",
    "nat": "national", "natl": "national", "intl": "international", "acad": "academy", "analytic": "analytics", "coll": "college",
    "dept": "department", "hosp": "hospital", "assoc": "association", "soc": "society", "sci": "science", "sciences": "science",
    "eng": "engineering", "sch": "school", "fac": "faculty", "ctr": "center",
}
#: Legal forms and words that join others; they tell nothing apart.
_FILLERS = {
    "the", "of", "and", "for", "at", "in", "de", "der", "und", "et", "gmbh", "mbh", "ag", "kg", "inc", "ltd", "limited", "llc", "plc", "sa", "srl",
    "bv", "nv", "oy", "ab", "co", "corp", "corporation", "company",
}
_GENERIC = {**{w: w for w in GENERIC}, **GENERIC_FORMS}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the summed lengths; 0 if either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    return 2 * (len(a) - (row & ((1 << len(a)) - 1)).bit_count()) / (len(a) + len(b))


def read_organisation(text: str) -> tuple[str, str] | None:
    """(generic words, proper name) of an organisation's name; without generic words the first is empty."""
    clean = re.sub(r"\b(?:[^\W\d_]\.){2,}", lambda m: m[0].replace(".", ""), canonical(text).strip())
    generic: set[str] = set()
    proper: list[str] = []
    for word in re.findall(r"[^\W\d_]+", fold(clean)):
        if word in _FILLERS:
            continue
        known = _GENERIC.get(word)
        if known is None and len(word) >= 4:
            near = max(_GENERIC, key=lambda w: lcs_ratio(word, w))
            known = _GENERIC[near] if lcs_ratio(word, near) >= 0.8 else None
        if known:
            generic.add(known)
        elif len(word) > 1:
            proper.append(word)
    return (" ".join(sorted(generic)), "".join(proper)) if proper else None


def split_person(text: str) -> tuple[list[str], list[str]] | None:
    """Name parts as typed: (parts before a comma or all parts, parts after it); None if it names nobody."""
    clean = re.sub(r"\s+", " ", canonical(text)).strip()
    if not clean or COLLECTIVE.search(clean) or re.search(r"\d", clean):
        return None
    head, comma, tail = clean.partition(",")
    parts = []
    for side in (head, tail):
        words = []
        for raw in re.findall(r"[^\W\d_][^\s,.]*\.?|[^\W\d_]\.", side):
            word = fold(raw)
            bare = word.rstrip(".")
            letters = raw.rstrip(".")
            if words and 1 < len(bare) <= 3 and letters.isupper() and not comma and not side.isupper():
                words.append(bare[0] + ".")  # a run of initials after the surname
                continue
            if bare in TITLES or not bare:
                continue
            if bare.startswith("al-"):
                word = word[3:]
            if word.rstrip(".") in PARTICLES and not word.endswith("."):
                continue
            words.append(word if word.endswith(".") or len(bare) > 1 else bare + ".")
        parts.append(words)
    if not comma:
        return parts[0], []
    return parts[0], parts[1]


def read_person(first: list[str], rest: list[str], given_score) -> tuple[str, str] | None:
    """(surname, given) with given "" or full, "x." an initial, "kath." a cut form.

    `given_score(word)` is the share of given-name positions among the word's positions in the whole column; it decides
    the order of two full words without a comma.
    """
    if rest:
        surname = [w for w in first if not w.endswith(".")] or first
        given = next((w for w in rest if not w.endswith(".")), rest[0])
        return surname[-1].rstrip("."), given
    whole = [w for w in first if not w.endswith(".")]
    short = [w for w in first if w.endswith(".")]
    if len(whole) >= 2:
        a, b = whole[0], whole[-1]
        return (a, b) if given_score(b) > given_score(a) else (b, a)
    if len(whole) == 1:
        return whole[0], max(short, key=len, default=".")
    return None


def _unmatched(n: int, m: int, ratio: float) -> tuple[int, int] | None:
    """(letters that values of lengths n and m may leave unmatched) within the ratio; None if no such pair reaches it."""
    least = next((x for x in range(min(n, m) + 1) if 2 * x / (n + m) >= ratio), None)
    return None if least is None else (n - least, m - least)


def suffix_heads(text: str, ratio: float) -> Iterator[tuple[str, bool, int, int, int]]:
    """(key, is the shorter, place, i, j) of the heads of all suffixes, for each length a near value may have.

    The unmatched letters i and j of a pair cut its common subsequence into at most i + j + 1 blocks, so one block has at
    least that share of its letters, and the suffixes that begin with it have the same head. Its places in the two
    values differ by at most i one way and j the other. Equal values need no key.
    """
    size = len(text)
    for other in range(1, int(size * (2 - ratio) / ratio) + 2):
        lo, hi = min(size, other), max(size, other)
        unmatched = _unmatched(lo, hi, ratio)
        if unmatched is None or not sum(unmatched):
            continue
        i, j = unmatched
        long = -(-(lo - i) // (i + j + 1))
        for at in range(size - long + 1):
            for shorter in {size == lo, size != hi}:
                yield f"{lo} {hi} {text[at : at + long]}", shorter, at, i, j


def letters(text: str) -> int:
    """A 63-bit set of the letters, each with its number: two sets differ in at most the unmatched letters of a pair."""
    seen: dict[str, int] = {}
    out = 0
    for char in text:
        seen[char] = seen.get(char, 0) + 1
        out |= 1 << (ord(char) * 7 + seen[char] * 29) % 63
    return out


def _heads(values: DataFrame) -> DataFrame:
    """(kind, x, key, shorter, at, i, j, letters) of distinct values (kind, x); a kind ends in the number of its field."""

    def heads(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for kind, x in zip(*(c.to_pylist() for c in batch.columns)):
            said = letters(x)
            rows += [(kind, x, *head, said) for head in set(suffix_heads(x, RATIO_NAME if kind[-1] == "1" else RATIO_SECOND))]
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int16(), pa.int16(), pa.int16(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["kind", "x", "key", "shorter", "at", "i", "j", "letters"])

    schema = "kind string, x string, key string, shorter boolean, at smallint, i smallint, j smallint, letters bigint"
    return _map(values.select("kind", "x"), heads, schema).withColumn("key", F.xxhash64("kind", "key"))


def _may_be_near() -> Column:
    """Whether a shorter value and a longer one (`y`, `at_y`, `letters_y`) that share a head can reach the ratio."""
    unmatched = F.bit_count(F.col("letters").bitwiseXOR(F.col("letters_y"))) <= F.col("i") + F.col("j")
    return (F.col("at_y") - F.col("at")).between(-F.col("i"), F.col("j")) & unmatched & (F.col("x") != F.col("y"))


def _longer(heads: DataFrame, *more: str) -> DataFrame:
    return heads.filter("not shorter").select("key", F.col("x").alias("y"), F.col("at").alias("at_y"), F.col("letters").alias("letters_y"), *more)


def near_values(values: DataFrame, common: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(near, hot): near is (kind, x, y), all ordered pairs of distinct values (kind, x) within the ratio, equal ones too.

    Heads of first fields that more than `common` values share make no pairs; they are returned as `hot`, None if there
    are none.
    """
    heads = durable(_heads(values))
    sizes = heads.filter(F.col("kind").endswith("1")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > (COMMON if common is None else common))
    crowded = durable(sizes.select("key"))
    hot = None
    cool = heads
    if not crowded.isEmpty():
        hot = heads.join(crowded, "key", "left_semi")
        cool = heads.join(crowded, "key", "left_anti")
    met = cool.filter("shorter").join(_longer(cool), "key").filter(_may_be_near())
    pairs = met.select("kind", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    one = pairs.filter(_ratio()("x", "y") >= F.when(F.col("kind").endswith("1"), RATIO_NAME).otherwise(RATIO_SECOND))
    one = one.withColumn("both", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))).select("kind", "both.x", "both.y")
    return durable(one.unionByName(values.select("kind", "x", F.col("x").alias("y")))), hot


def _ratio():
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratio, DoubleType())


def link_forms(forms: DataFrame, common: int | None = None) -> DataFrame:
    """Distinct links (a, b) of `forms` (form, x1, x2): all pairs whose fields x1 and x2 reach their ratios.

    The first letter of a form is its kind; forms of different kinds never meet. The result does not depend on `common`.
    """
    typed = durable(forms.select("form", F.left("form", F.lit(1)).alias("kind"), "x1", "x2").filter("x1 <> '' and x2 <> ''").distinct())
    fields = F.explode(F.array(*[F.struct(F.concat("kind", F.lit(str(n))).alias("kind"), F.col(f"x{n}").alias("x")) for n in (1, 2)]))
    near, hot = near_values(durable(typed.select(fields.alias("v")).select("v.*").distinct()), common)
    side = lambda n: near.filter(F.col("kind").endswith(str(n))).select(F.left("kind", F.lit(1)).alias("kind"), F.col("x").alias(f"x{n}"), "y")
    left = typed.join(side(1), ["kind", "x1"]).select("kind", F.col("form").alias("a"), F.col("y").alias("k1"), F.col("x2").alias("k2"))
    right = typed.join(side(2), ["kind", "x2"]).select("kind", F.col("form").alias("b"), F.col("x1").alias("k1"), F.col("y").alias("k2"))
    links = left.join(right, ["kind", "k1", "k2"]).filter("a < b").select("a", "b")
    if hot is None:
        return links
    # Forms meet in a common head of their first fields where their second fields are near.
    held = typed.join(hot.select(F.left("kind", F.lit(1)).alias("kind"), F.col("x").alias("x1"), "key", "shorter", "at", "i", "j", "letters"), ["kind", "x1"])
    held = held.withColumnRenamed("x1", "x")
    here = held.filter("shorter").join(side(2), ["kind", "x2"]).withColumnRenamed("y", "second").withColumnRenamed("form", "a")
    there = _longer(held.withColumn("b", F.col("form")), "b", F.col("x2").alias("second"))
    met = here.join(there, ["key", "second"]).filter(_may_be_near()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "x", "y").distinct()
    return links.unionByName(met.filter(_ratio()("x", "y") >= RATIO_NAME).select("a", "b")).distinct()


def nearest_links(links: DataFrame, forms: DataFrame) -> DataFrame:
    """Of all links (a, b) of `forms` (form, x1, x2, n), for each form the one to the nearest form that stands more often.

    A form without a more frequent one keeps the link to its nearest form. So a misspelling that is near two frequent
    names belongs to the nearer one and does not join them. Ties go to the more frequent form, then to the last in order.
    """
    side = lambda x: forms.select(F.col("form").alias(x), F.col("x1").alias(f"{x}1"), F.col("x2").alias(f"{x}2"), F.col("n").alias(f"n{x}"))
    both = links.join(side("a"), "a").join(side("b"), "b").withColumn("near", _ratio()("a1", "b1") + _ratio()("a2", "b2"))
    ways = F.array(*[F.struct(F.col(x).alias("form"), F.col(y).alias("other"), F.col(f"n{x}").alias("own"), F.col(f"n{y}").alias("n")) for x, y in ("ab", "ba")])
    said = both.select("near", F.explode(ways).alias("w")).select("near", "w.*")
    higher = F.struct("n", "other") > F.struct(F.col("own").alias("n"), F.col("form").alias("other"))
    return said.groupBy("form").agg(F.max_by("other", F.struct(higher.alias("higher"), "near", "n", "other")).alias("other")).select(F.col("form").alias("a"), F.col("other").alias("b"))


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def person_forms(strings: DataFrame) -> DataFrame:
    """(s, surname, given) of the strings (s) that name a person."""

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(s, *p) for s, p in ((s, split_person(s)) for s in batch.column(0).to_pylist()) if p]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["s", "first", "rest"])

    split = durable(_map(strings.select("s"), parts, "s string, first array<string>, rest array<string>"))
    # Positions of words: before a comma or last is a surname's, after a comma or first is a given name's.
    whole = lambda c: F.filter(c, lambda w: ~w.endswith("."))
    typed = split.select(
        F.when(F.size("rest") > 0, F.get(whole(F.col("rest")), F.lit(0))).otherwise(F.get(whole(F.col("first")), F.lit(0))).alias("g"),
        F.element_at(F.when(F.size(whole(F.col("first"))) > 0, whole(F.col("first"))), -1).alias("f"),
        (F.size("rest") > 0).alias("comma"),
        F.size(whole(F.col("first"))).alias("n"),
    ).filter("comma or n >= 2")
    votes = typed.select(F.col("g").alias("w"), F.when(F.col("comma"), 3).otherwise(1).alias("up"), F.lit(0).alias("down")).unionByName(
        typed.select(F.col("f").alias("w"), F.lit(0).alias("up"), F.when(F.col("comma"), 3).otherwise(1).alias("down"))
    )
    votes = votes.filter("w is not null").groupBy("w").agg((F.sum("up") / F.sum(F.col("up") + F.col("down"))).alias("share"))
    side = lambda name: votes.select(F.col("w").alias(name), F.col("share").alias(f"{name}_share"))
    full = whole(F.col("first"))
    scored = (
        split.withColumn("w0", F.get(full, F.lit(0)))
        .withColumn("w1", F.when(F.size(full) > 1, F.element_at(full, -1)))
        .join(side("w0"), "w0", "left")
        .join(side("w1"), "w1", "left")
        .select("s", "first", "rest", "w0", "w1", F.coalesce("w0_share", F.lit(0.5)).alias("s0"), F.coalesce("w1_share", F.lit(0.5)).alias("s1"))
    )

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for s, first, rest, w0, w1, s0, s1 in zip(*(c.to_pylist() for c in batch.columns)):
            known = lambda w: 1.0 if w in NICKNAMES or w in _FORMAL else s0 if w == w0 else s1
            got = read_person(first, rest, known)
            if got:
                surname, given = got
                formal = _FORMAL.get(given)
                rows.append((s, surname, formal[0] if formal else given))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["s", "surname", "given"])

    return _map(scored, read, "s string, surname string, given string")


def organisation_forms(strings: DataFrame) -> DataFrame:
    """(s, proper, generic) of the strings (s) that name an organisation."""

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(s, got[1], got[0]) for s, got in ((s, read_organisation(s)) for s in batch.column(0).to_pylist()) if got]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["s", "proper", "generic"])

    return _map(strings.select("s"), read, "s string, proper string, generic string")


def link_names(people: DataFrame | None, organisations: DataFrame | None, aliases: DataFrame | None = None) -> DataFrame:
    """(s, entity) of strings (s, n) of persons and of organisations, n being how often the string stands.

    Both kinds are linked and closed in one pass; either may be None. `aliases` has (kind, name, alias), kind being P or
    O: the rows that give an alias to a name, as often as they stand; null sides are ignored.
    """
    parts = []
    if people is not None:
        read = person_forms(people).select("s", F.lit("P").alias("kind"), F.col("surname").alias("x1"), F.col("given").alias("x2"))
        parts.append(read.join(people, "s"))
    if organisations is not None:
        read = organisation_forms(organisations).select("s", F.lit("O").alias("kind"), F.col("proper").alias("x1"), F.col("generic").alias("x2"))
        parts.append(read.join(organisations, "s"))
    named = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = durable(named.select("s", F.concat_ws(" ", "kind", "x2", "x1").alias("form"), "x1", "x2", (F.col("x2").endswith(".") | (F.col("x2") == "")).alias("short"), "n"))
    forms = durable(named.groupBy("form", "x1", "x2", "short").agg(F.sum("n").alias("n")))
    whole = forms.filter("not short").select("form", "x1", "x2", "n")
    links, rows = nearest_links(link_forms(whole), whole), None
    if aliases is not None:
        side = lambda name: named.select(F.left("form", F.lit(1)).alias("kind"), F.col("s").alias(name), F.col("form").alias(f"{name}_form"), F.col("short").alias(f"{name}_short"))
        given = aliases.filter("name is not null and alias is not null").groupBy("kind", "name", "alias").agg(F.count(F.lit(1)).alias("times"))
        rows = given.join(side("name"), ["kind", "name"]).join(side("alias"), ["kind", "alias"]).filter("name_form <> alias_form and not (name_short and alias_short)")
        rows = durable(rows.groupBy("name_form", "name_short", "alias_form", "alias_short").agg(F.sum("times").alias("times")))
        links = links.unionByName(rows.filter("not name_short and not alias_short").select(F.col("name_form").alias("a"), F.col("alias_form").alias("b")))
    nodes = connected_components(links)
    entities = whole.join(nodes, F.col("form") == F.col("node"), "left").select("form", "x1", "x2", "n", F.coalesce("component", "form").alias("entity"))
    entities = durable(entities)
    every = entities.select("form", "entity").unionByName(_attach(forms.filter("short"), entities, rows))
    return named.select("s", "form").join(every, "form").select("s", "entity")


def _attach(short: DataFrame, entities: DataFrame, rows: DataFrame | None) -> DataFrame:
    """(form, entity) of the forms that name no one alone.

    The entity that most rows give the form comes first. Else a person's given name has to begin with what is left, and
    the surname to be near (a common suffix or beginning); of several persons the nearest, then the most frequent.
    Persons that fit none share an entity by surname and initial; other forms are their own entity.
    """
    weights = entities.groupBy("entity").agg(F.sum("n").alias("weight"))
    own = entities.filter("startswith(form, 'P')")
    ends = F.array_distinct(F.array(F.right("x1", F.lit(MIN_SUFFIX)), F.concat(F.lit("^"), F.left("x1", F.lit(MIN_SUFFIX)))))
    people = short.filter("startswith(form, 'P') and x2 <> '.'")
    cut = people.select("form", "x1", F.expr("left(x2, length(x2) - 1)").alias("stem"), F.left("x2", F.lit(1)).alias("initial"), F.explode(ends).alias("block"))
    full = own.select(F.col("x1").alias("y1"), F.col("x2").alias("given"), "entity", F.left("x2", F.lit(1)).alias("initial"), F.explode(ends).alias("block")).distinct()
    fits = cut.join(full, ["block", "initial"]).filter(F.expr("startswith(given, stem)")).join(weights, "entity")
    fits = fits.withColumn("near", _ratio()("x1", "y1")).filter(F.col("near") >= RATIO_NAME).select("form", "entity", F.lit(0).cast("bigint").alias("times"), "near", "weight")
    if rows is not None:
        said = rows.filter("alias_short").select(F.col("alias_form").alias("form"), F.col("name_form").alias("other"), "times")
        said = said.unionByName(rows.filter("name_short").select(F.col("name_form").alias("form"), F.col("alias_form").alias("other"), "times"))
        told = said.join(entities.select(F.col("form").alias("other"), "entity"), "other").groupBy("form", "entity").agg(F.sum("times").alias("times"))
        fits = fits.unionByName(told.join(weights, "entity").select("form", "entity", "times", F.lit(1.0).alias("near"), "weight"))
    best = fits.groupBy("form").agg(F.max_by("entity", F.struct("times", "near", "weight", "entity")).alias("best"))
    alone = F.when(F.expr("startswith(form, 'P') and x2 <> '.'"), F.concat_ws(" ", F.lit("P"), "x1", F.concat(F.lit("~"), F.left("x2", F.lit(1))))).otherwise(F.col("form"))
    return short.join(best, "form", "left").select("form", F.coalesce("best", alone).alias("entity"))


def link_persons(strings: DataFrame) -> DataFrame:
    """(s, entity) of strings (s, n) of persons."""
    return link_names(strings, None)


def link_organisations(strings: DataFrame) -> DataFrame:
    """(s, entity) of strings (s, n) of organisations."""
    return link_names(None, strings)


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """Distinct (name_a, name_b), name_a before name_b by bytes, of the different strings of each entity."""
    linked = durable(linked.distinct())
    a, b = linked.select("entity", F.col("s").alias("name_a")), linked.select("entity", F.col("s").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()

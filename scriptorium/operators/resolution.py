"""Entity names: normal forms, guards, pairs, components and alias maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.tokens import strip
from scriptorium.operators.components import connected_components
from scriptorium.operators.retrieval import dot, hashed_embedding
from scriptorium.sources.tables import durable

#: Words that name a kind of thing rather than the thing.
NOISE_WORDS = {
    "model", "models", "method", "methods", "approach", "approaches", "system", "systems", "algorithm", "algorithms", "technique",
    "techniques", "framework", "frameworks", "architecture", "dataset", "datasets", "benchmark", "benchmarks", "task", "tasks", "score", "scores",
}
#: Suffixes of word forms, the first that fits is cut.
SUFFIXES = ["ation", "ional", "ing", "ion", "er", "or", "al"]
#: Fixed value: a year.
YEAR = r"\b(?:1[89]|20)\d{2}\b"
COSINE, OVERLAP, LEAST_NAME = 0.92, 0.8, 3


_PLAIN_BRACKET = rf"\((?![^()]*{YEAR})[^()]*\)"
_TAIL = rf"\s*{_PLAIN_BRACKET}\s*(?:\+\s*[A-Za-z0-9_-]{{1,12}}\s*)?"
_NOISE = "|".join(sorted(NOISE_WORDS))
_STEM = rf"^(.{{3,}}?)({'|'.join(SUFFIXES)})$"


def strip_config(name: Column) -> Column:
    """A name without trailing configuration: brackets unless they hold a year, and a modifier that stands on one.

    One pattern takes the whole tail of such groups and leaves LEAST_NAME characters at least; a modifier on a bracket
    that has to stay goes as well. Null stays null.
    """
    whole = strip(name)
    cut = F.regexp_extract(whole, rf"(?U)^(\S.{{{LEAST_NAME - 1},}}?)(?<=\S)(?:{_TAIL})+$", 1)
    kept = F.regexp_replace(whole, rf"(?U)({_PLAIN_BRACKET})\s*\+\s*[A-Za-z0-9_-]{{1,12}}$", "$1")
    return F.when(whole.contains("("), F.coalesce(F.nullif(cut, F.lit("")), kept)).otherwise(whole)


def _stem(word: Column) -> Column:
    """A word without its plural and without the first of SUFFIXES that leaves three letters."""
    size = F.length(word)
    many = F.when(word.endswith("es") & ~word.rlike("[si]es$") & (size > 4), 2).when(word.endswith("s") & ~word.endswith("ss") & (size > 3), 1).otherwise(0)
    return F.regexp_replace(F.substring(word, F.lit(1), size - many), _STEM, "$1")


def normal_form(name: Column) -> Column:
    """Lower case, no punctuation, no trailing noise words while another one is left, words cut to a stem."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_config(name)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    words = F.split(F.regexp_replace(spaced, rf"(?<=\S)(?: (?:{_NOISE}))+$", ""), " ")
    return F.array_join(F.transform(words, _stem), " ")


def numbers(name: Column) -> Column:
    """Sorted distinct runs of digits."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))))


def digits_conflict(a: Column, b: Column) -> Column:
    """Both names have numbers, and other ones."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two arrays of words; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def valid_name(name: Column) -> Column:
    """2 to 200 characters, starting with an ASCII letter or digit, with a letter."""
    trimmed = strip(name)
    return F.length(trimmed).between(2, 200) & trimmed.rlike("^[A-Za-z0-9]") & trimmed.rlike(r"\p{L}")


def similar_names(names: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(type, a, b), a < b: names (type, name, norm, v) of one type with overlap, cosine and no conflict of numbers.

    Pairs meet in a shared word (an overlap of 0.8 implies one): the rarest words of each name that an overlap of 0.8
    cannot avoid are its block keys, so a word that a third of all names share is a key of hardly any.
    """
    words = names.select("type", "name", "v", F.array_distinct(F.split("norm", " ")).alias("words"), numbers(F.col("name")).alias("digits"))
    rare = words.select("type", "name", "v", "words", "digits", F.explode("words").alias("word"))
    counted = rare.join(rare.groupBy("type", "word").agg(F.count(F.lit(1)).alias("c")), ["type", "word"])
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("type", "name").orderBy("c", "word")))
    keys = ranked.filter(F.col("r") <= F.size("words") - F.ceil(F.lit(OVERLAP) * F.size("words")) + 1)
    side = lambda n: keys.select("type", "word", *[F.col(c).alias(f"{c}_{n}") for c in ("name", "words", "digits", "v")])
    pairs = side("a").join(side("b"), ["type", "word"]).filter("name_a < name_b")
    norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    cosine = dot(F.col("v_a"), F.col("v_b")) / F.when(norm("v_a") * norm("v_b") > 0, norm("v_a") * norm("v_b")).otherwise(1.0)
    keep = (overlap(F.col("words_a"), F.col("words_b")) >= OVERLAP) & ~digits_conflict(F.col("digits_a"), F.col("digits_b")) & (cosine >= threshold)
    return pairs.filter(keep).select("type", F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()


def resolve_entities(names: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(type, name, canonical): names (type, name) merged by normal form, by de-spaced form and by similarity.

    Groups by form hang on their shortest, then first name; pairs with conflicting numbers stay apart. The canonical
    name is the longest of the component (then the last in order) without its configuration.
    """
    given = durable(names.select("type", "name").filter("name is not null and type is not null").distinct().withColumn("norm", normal_form(F.col("name"))).withColumn("v", hashed_embedding(F.col("name"))))
    tagged = given.withColumn("digits", numbers(F.col("name")))

    def star(form: Column) -> DataFrame:
        formed = tagged.withColumn("form", form).filter("form <> ''").select("type", "form", "name", "digits")
        # The head of a form is found by a partial aggregate; AQE splits the join at a form that many names share.
        heads = formed.groupBy("type", "form").agg(F.min_by(F.struct("name", "digits"), F.struct(F.length("name"), F.col("name"))).alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        both = formed.join(heads, ["type", "form"]).filter((F.col("name") != F.col("h.name")) & ~digits_conflict(F.col("digits"), F.col("h.digits")))
        return both.select("type", F.col("h.name").alias("a"), F.col("name").alias("b"))

    links = star(F.col("norm")).unionByName(star(F.replace(F.col("norm"), F.lit(" "), F.lit("")))).unionByName(similar_names(given.filter("type <> 'Paper'"), threshold))
    node = lambda c: F.concat_ws("\u0001", F.col("type"), F.col(c))
    found = connected_components(links.select(node("a").alias("a"), node("b").alias("b")))
    member = given.withColumn("node", node("name")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = member.groupBy("component").agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("root"))
    return member.join(best, "component").select("type", "name", strip_config(F.col("root")).alias("canonical"))


def alias_map(entities: DataFrame) -> DataFrame:
    """(key, canonical, type): every valid name and alias of entities (name, type, aliases), lower-cased without configuration.

    An alias points at its entity's name. The canonical name is the longest one without configuration, else the longest,
    then the last in order; the type is the most frequent, then the last in order.
    """
    own = entities.select(strip(F.col("name")).alias("surface"), strip(F.col("name")).alias("name"), "type")
    other = entities.select(strip(F.col("name")).alias("name"), "type", F.explode("aliases").alias("surface")).select(strip(F.col("surface")).alias("surface"), "name", "type")
    every = own.unionByName(other.select("surface", "name", "type")).filter(valid_name(F.col("surface")) & valid_name(F.col("name")))
    keyed = every.select(F.lower(strip_config(F.col("surface"))).alias("key"), "name", "type", (strip_config(F.col("name")) == F.col("name")).alias("plain"))
    names = keyed.groupBy("key").agg(F.max_by("name", F.struct(F.col("plain"), F.length("name"), F.col("name"))).alias("canonical"))
    kinds = keyed.groupBy("key", "type").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("type", F.struct("c", "type")).alias("type"))
    return names.join(kinds, "key")


def merged_aliases(entities: DataFrame) -> DataFrame:
    """(key, canonical, type): `alias_map` with its canonical names merged by `resolve_entities`, one type for each name.

    A name's type is the most frequent among its keys, then the last in order.
    """
    aliases = durable(alias_map(entities))
    typed = lambda rows, name: rows.groupBy(name, "type").agg(F.count(F.lit(1)).alias("c")).groupBy(name).agg(F.max_by("type", F.struct("c", "type")).alias("type"))
    merged = resolve_entities(typed(aliases, "canonical").select("type", F.col("canonical").alias("name")))
    named = durable(aliases.select("key", F.col("canonical").alias("name")).join(merged, "name").select("key", "canonical", "type"))
    return named.select("key", "canonical").join(typed(named, "canonical"), "canonical").select("key", "canonical", "type")


def merge_audit(entities: DataFrame) -> DataFrame:
    """(type, canonical, merged) of the names that were merged under another, in order."""
    valid = entities.filter(valid_name(F.col("name"))).select("type", strip(F.col("name")).alias("name"))
    merged = resolve_entities(valid).groupBy("type", "canonical").agg(F.array_sort(F.collect_set("name")).alias("merged"))
    return merged.filter(F.size("merged") > 1)


def endpoint_key(column: str) -> Column:
    """The key of an alias map that a relation's end is looked up by."""
    return F.lower(strip_config(strip(F.col(column))))


def resolve_endpoint(df: DataFrame, column: str, aliases: DataFrame, out: str, strict: bool = True) -> DataFrame:
    """`df` with `out` = the canonical name of `column`; strict: rows without one are dropped, else the raw text is kept."""
    table = aliases.select(F.col("key").alias("__key"), F.col("canonical").alias("__canonical"))
    joined = df.withColumn("__key", endpoint_key(column)).join(table, "__key", "inner" if strict else "left")
    found = F.col("__canonical") if strict else F.coalesce("__canonical", strip(F.col(column)), F.lit(""))
    return joined.withColumn(out, found).drop("__key", "__canonical")

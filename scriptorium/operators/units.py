"""Quantities recorded in different units, brought to one unit each (problem 4).

Plain relational expressions: the metric's text is split by `regexp_extract` into a name and a unit, the name is
normalised by a join with the alias table, the units of its quantity come with it, and the value takes the first unit
that applies: that of the metric, that which follows the same number in the evidence, or the default of its quantity.
Then factor and offset are applied.

Every distinct text of a metric is read once. A name that is no alias joins those of the same numbers and of nearly its
length and takes the nearest within a bound on the edits (`levenshtein`), else one that it is a contraction of (inner
letters left out).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.lexicon import METRIC_ALIASES, UNITS
from scriptorium.sources.tables import broadcast_if_small

#: A name, then a unit in brackets, after a comma, after a spaced hyphen or after "in".
NAME_AND_UNIT = r"^\s*(.*?)(?:\s*[(\[]\s*([^()\[\]]+?)\s*[)\]]|\s*,\s*([^,]+?)|\s+-\s+([^-]+?)|\s+in\s+([^ ].*?))\s*$"
NUMBER = r"(?<![\w.,])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d*\.\d+|\d+)"
#: (letters and digits of a name, edits it may have) in order; longer names may have MOST_EDITS.
EDITS, MOST_EDITS = [(4, 0), (6, 1), (13, 2)], 3
#: Share of an alias's letters that a contraction keeps at least, and its fewest letters.
CONTRACTION_SHARE, CONTRACTION_LETTERS = 0.6, 5


def metric_key(text: Column) -> Column:
    """Letters and digits of a metric's name in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def _number_and_unit() -> str:
    spellings = sorted({s for units in UNITS.values() for group in units.values() for s in group}, key=lambda s: (-len(s), s))
    return NUMBER + r"\s*(" + "|".join(re.escape(s) for s in spellings) + r")(?![A-Za-z0-9/])"


def edits_allowed(length: Column) -> Column:
    """Edits that a name of so many letters and digits may have."""
    out = F.when(length <= EDITS[0][0], EDITS[0][1])
    for most, edits in EDITS[1:]:
        out = out.when(length <= most, edits)
    return out.otherwise(MOST_EDITS)


def numbers_in(key: Column) -> Column:
    """The numbers of a key, in order, as one string."""
    return F.array_join(F.regexp_extract_all(key, F.lit(r"\d+"), F.lit(0)), " ")


def metric_spellings(terms: DataFrame) -> DataFrame:
    """(spelling, quantity): the keys of the metrics of `terms` (field, canonical, quantity) and of their synonyms."""
    spark = terms.sparkSession
    aliases = spark.createDataFrame([(c, s) for c, group in METRIC_ALIASES.items() for s in group], "canonical string, said string")
    entries = terms.filter("field = 'metric' and quantity is not null").select("canonical", "quantity")
    every = entries.select("quantity", F.col("canonical").alias("said")).unionByName(entries.join(F.broadcast(aliases), "canonical").select("quantity", "said"))
    return every.groupBy(metric_key(F.col("said")).alias("spelling")).agg(F.min("quantity").alias("quantity")).filter("spelling <> ''")


def read_metrics(metrics: DataFrame, spellings: DataFrame) -> DataFrame:
    """(metric, quantity, unit): distinct texts (metric) that denote a metric of `spellings` (spelling, quantity).

    The first reading that fits counts: the whole text, its name beside a unit, the name with edits beside a unit of the
    metric's quantity, the whole text with edits, the name with edits, and contractions in the same order. A whole text
    that denotes a metric has no unit. Equal distances go to the spelling that is first in order.
    """
    units = metrics.sparkSession.createDataFrame([(q, [s for group in by.values() for s in group]) for q, by in UNITS.items()], "quantity string, known array<string>")
    table = spellings.join(F.broadcast(units), "quantity").withColumn("numbers", numbers_in(F.col("spelling")))
    part = lambda group: F.regexp_extract("metric", NAME_AND_UNIT, group)
    unit = F.coalesce(*[F.nullif(part(g), F.lit("")) for g in (2, 3, 4, 5)])
    readings = F.array(F.struct(F.lit(0).alias("part"), metric_key(F.col("metric")).alias("key"), F.lit(None).cast("string").alias("unit")), F.struct(F.lit(1).alias("part"), metric_key(part(1)).alias("key"), unit.alias("unit")))
    said = metrics.select("metric", F.explode(readings).alias("r")).select("metric", "r.*").filter("key <> ''").withColumn("numbers", numbers_in(F.col("key")))

    own = F.struct(F.col("spelling"), F.col("quantity"), F.col("unit"))
    exact = said.join(table, F.col("key") == F.col("spelling")).select("metric", F.struct(F.col("part").alias("stage"), F.lit(0).alias("far"), own.alias("own")).alias("found"))
    size = F.length("spelling")
    reach = edits_allowed(size)
    wide = table.withColumn("size", F.explode(F.sequence(size - reach, size + reach)))
    near = said.withColumn("size", F.length("key")).join(wide, ["numbers", "size"]).withColumn("far", F.levenshtein("key", "spelling"))
    near = near.filter((F.col("far") > 0) & (F.col("far") <= F.least(reach, edits_allowed(F.length("key") + 2))))
    stage = F.when(F.array_contains("known", F.col("unit")), 2).when(F.col("part") == 0, 3).otherwise(4)
    near = near.select("metric", F.struct(stage.alias("stage"), "far", own.alias("own")).alias("found"))
    ends = lambda c: F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).alias("ends")
    short = said.select("*", ends("key")).join(table.select("*", ends("spelling")), ["numbers", "ends"])
    short = short.filter((F.length("key") >= CONTRACTION_LETTERS) & (F.length("key") < size) & (F.length("key") >= CONTRACTION_SHARE * size))
    short = short.filter(F.expr("spelling rlike concat('^', array_join(split(key, ''), '[a-z0-9]*'), '$')"))
    short = short.select("metric", F.struct((F.col("part") + 5).alias("stage"), (size - F.length("key")).alias("far"), own.alias("own")).alias("found"))
    best = exact.unionByName(near).unionByName(short).groupBy("metric").agg(F.min("found").alias("best"))
    return best.select("metric", "best.own.quantity", "best.own.unit")


def convert_values(claims: DataFrame, terms: DataFrame) -> DataFrame:
    """(claim_id, target_value): distinct claims whose value can be converted, in the target unit of its quantity.

    `claims` has claim_id, metric, value, evidence; `terms` has field, canonical, quantity. Null, NaN or negative values,
    metrics that denote no entry, and quantities other than score without a unit give no row. A null claim_id is kept.
    The readings of distinct metrics are broadcast where they are few bytes (measured), else joined by a shuffle.
    """
    spark = claims.sparkSession
    units = spark.createDataFrame(
        [(q, {s: (float(f), 0.0) for f, group in by.items() for s in group}) for q, by in UNITS.items()],
        "quantity string, units map<string,struct<factor:double,offset:double>>",
    )
    said = claims.select("claim_id", "metric", "value", "evidence").filter("value >= 0 and not isnan(value)")
    spellings = broadcast_if_small(metric_spellings(terms))
    read = broadcast_if_small(read_metrics(said.select("metric").filter("metric is not null").distinct(), spellings))
    known = said.join(read, "metric").join(F.broadcast(units), "quantity")

    pattern = F.lit(_number_and_unit())
    numbers = F.regexp_extract_all("evidence", pattern, F.lit(1))
    follows = F.regexp_extract_all("evidence", pattern, F.lit(2))
    same = lambda p: F.abs(F.regexp_replace(p["n"], ",", "").cast("double") - F.col("value")) <= F.col("value") * 1e-9
    pairs = F.arrays_zip(numbers.alias("n"), follows.alias("u"))
    told = F.filter(pairs, lambda p: same(p) & F.map_contains_key("units", p["u"]))
    score = F.col("quantity") == "score"
    default = F.when(score, F.struct(F.when(F.col("value") <= 1, 10_000.0).otherwise(100.0).alias("factor"), F.lit(0.0).alias("offset")))
    rule = F.coalesce(F.try_element_at("units", F.col("unit")), F.try_element_at("units", F.get(told, F.lit(0))["u"]), default)
    converted = known.select("claim_id", "value", rule.alias("rule")).filter("rule is not null")
    target = F.round(F.round(F.col("value") * F.col("rule.factor") + F.col("rule.offset"), 5)).cast("bigint")
    return converted.select("claim_id", target.alias("target_value")).distinct()

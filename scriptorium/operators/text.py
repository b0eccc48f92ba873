"""Reading order, cleaning, headings and sections of documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ligatures and the no-break space.
LITERALS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "\u00a0": " "}
#: Headings without a number.
BARE_HEADINGS = [
    "abstract", "introduction", "background", "related work", "method", "methods", "methodology", "approach", "model",
    "experiments", "experimental setup", "results", "evaluation", "analysis", "discussion", "ablation study", "limitations",
    "conclusion", "conclusions", "future work", "references", "bibliography", "acknowledgements", "acknowledgments",
    "appendix", "broader impact", "ethics statement",
]
#: Fixed value: headings with a number; the title is group 2.
NUMBERED_HEADING = r"^\s*((?:\d+|[IVXLC]+|[A-Z])(?:\.\d+)*)\.?\s+([A-Z][A-Za-z0-9 \-:,'&/]{2,60})\s*$"
#: Sections that carry nothing to extract.
NON_EXTRACTIVE = [
    "references", "bibliography", "acknowledgements", "acknowledgments", "appendix", "supplementary material",
    "author contributions", "funding", "conflicts of interest", "ethics statement",
]
#: Page furniture and full-width blocks.
FURNITURE_PAGES, FURNITURE_SHARE, FURNITURE_LENGTH, FULL_WIDTH = 4, 0.6, 120, 0.6
LEAST_TEXT = 500


def clean_text(raw: Column) -> Column:
    """Ligatures spelt out, hyphenated line ends rejoined, soft wraps undone, blanks collapsed; the order matters."""
    out = raw
    for old, new in LITERALS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"(?<![\n.?!:;])\n(?!\n)", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def heading(line: Column) -> Column:
    """The title of a heading line, null for any other line."""
    trimmed = F.trim(line)
    bare = F.lower(F.regexp_replace(trimmed, r"[.:]+$", ""))
    words = F.transform(F.split(bare, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100)))
    numbered = F.nullif(F.regexp_extract(trimmed, NUMBERED_HEADING, 2), F.lit(""))
    title = F.when(bare.isin(BARE_HEADINGS), F.array_join(words, " ")).otherwise(F.nullif(F.regexp_replace(F.trim(numbered), "[.:]+$", ""), F.lit("")))
    return F.when((F.length(trimmed) > 0) & (F.length(trimmed) <= 80), title)


def detect_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, title, char_start, char_end): half-open spans that tile each text.

    Text before the first heading is "Front Matter"; a text without headings is one "Body"; null texts have no section
    and an empty text has one empty Body. Offsets are code points.
    """
    given = docs.select(F.col(key), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    lines = given.select(key, F.length("t").alias("size"), F.posexplode(F.split("t", "\n")).alias("line", "said"))
    order = Window.partitionBy(key).orderBy("line")
    at = F.sum(F.length("said") + 1).over(order) - F.length("said") - 1
    marks = lines.withColumn("at", at.cast("int")).withColumn("title", heading(F.col("said")))
    heads = marks.filter("line = 0 or title is not null").withColumn("heads", F.count("title").over(Window.partitionBy(key)))
    titled = heads.withColumn(
        "title", F.coalesce("title", F.when(F.col("heads") == 0, F.lit("Body")).otherwise(F.lit("Front Matter")))
    )
    # A first line without a heading opens the front matter; it is empty only if the heading follows at once.
    ends = titled.withColumn("char_end", F.coalesce(F.lead("at").over(order), F.col("size")))
    ranked = ends.withColumn("ordinal", F.row_number().over(order) - 1)
    return ranked.select(key, F.col("ordinal").cast("int").alias("ordinal"), "title", F.col("at").alias("char_start"), F.col("char_end").cast("int").alias("char_end"))


def repeated_lines(pages: DataFrame, doc: str, page: str, text: str, share: float = FURNITURE_SHARE) -> DataFrame:
    """(doc, line, pages): running headers and footers of documents of at least four pages."""
    lines = pages.select(doc, page, F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.length("line") > 0)
    sizes = pages.groupBy(doc).agg(F.count_distinct(page).alias("total")).filter(F.col("total") >= FURNITURE_PAGES)
    seen = lines.groupBy(doc, "line").agg(F.count_distinct(page).alias("pages")).join(sizes, doc)
    cutoff = F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("total")))
    keep = (F.col("pages") >= cutoff) & (F.length("line") < FURNITURE_LENGTH) & ~F.col("line").endswith(".")
    return seen.filter(keep).select(doc, "line", F.col("pages").cast("bigint").alias("pages"))


def strip_repeated_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """`pages` (doc, page, text) without running headers and footers."""
    bad = repeated_lines(pages, doc, page, text).select(doc, "line")
    lines = pages.select(doc, page, F.posexplode(F.split(F.col(text), "\n")).alias("n", "said")).withColumn("line", F.trim("said"))
    kept = lines.join(bad, [doc, "line"], "left_anti").groupBy(doc, page)
    joined = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), "\n").alias(text))
    return pages.select(doc, page).join(joined, [doc, page], "left").select(doc, page, F.coalesce(text, F.lit("")).alias(text))


def reading_order(blocks: DataFrame, page: str, width: str) -> DataFrame:
    """(page, text) of text blocks (page, width, x0, y0, x1, text, block_type) in the order a reader takes.

    Full-width blocks above the columns come first, then the left and the right column, then the other full-width
    blocks; with one column or none, blocks go by (y0, text). Pages without text blocks give no row.
    """
    said = blocks.filter("block_type = 0")
    wide = (F.col("x1") - F.col("x0")) / F.col(width) > FULL_WIDTH
    left = (F.col("x0") + F.col("x1")) / 2 < F.col(width) / 2
    side = F.when(wide, "full").when(left, "left").otherwise("right")
    w = Window.partitionBy(page)
    placed = (
        said.withColumn("side", side)
        .withColumn("lefts", F.count(F.when(F.col("side") == "left", 1)).over(w))
        .withColumn("rights", F.count(F.when(F.col("side") == "right", 1)).over(w))
        .withColumn("top", F.min(F.when(F.col("side") != "full", F.col("y0"))).over(w))
    )
    band = (
        F.when((F.col("lefts") == 0) | (F.col("rights") == 0), 0)
        .when(F.col("side") == "left", 1)
        .when(F.col("side") == "right", 2)
        .when(F.col("y0") < F.col("top"), 0)
        .otherwise(3)
    )
    ordered = F.array_sort(F.collect_list(F.struct(band.alias("band"), "y0", F.trim("text").alias("text"))))
    return placed.groupBy(page).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


def safe_file_name(name: Column) -> Column:
    """An id as a file name."""
    return F.translate(name, "/", "_")


def collapse_blanks(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_extractive(title: Column) -> Column:
    """Whether a section may be extracted from."""
    return ~F.lower(F.trim(title)).isin(NON_EXTRACTIVE)


def estimate_tokens(text: str) -> int:
    """The token estimate of one text, on the driver or in a worker."""
    return max(1, int(len(text.split()) * 1.3)) if text else 0


PARAGRAPH_BREAK, SENTENCE_BREAK = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")
_NUMBERED = re.compile(NUMBERED_HEADING)
_BARE = {h: " ".join(w[:1].upper() + w[1:] for w in h.split(" ")) for h in BARE_HEADINGS}


def section_tiles(text: str) -> list[tuple[str, int, int]]:
    """(title, char_start, char_end) of one text's sections, as `detect_sections` has them, for use inside a batch."""
    marks, at = [], 0
    for line in text.split("\n"):
        said = line.strip(" ")
        if 0 < len(said) <= 80:
            title = _BARE.get(said.rstrip(".:").lower())
            if title is None and (found := _NUMBERED.match(said)):
                title = found[2].strip(" ").rstrip(".:")
            if title:
                marks.append((title, at))
        at += len(line) + 1
    if not marks:
        return [("Body", 0, len(text))]
    if marks[0][1] > 0:
        marks.insert(0, ("Front Matter", 0))
    return [(title, start, end) for (title, start), (_, end) in zip(marks, [*marks[1:], ("", len(text))])]


def parse_pages(blocks: DataFrame, doc: str, page: str, width: str, least: int = LEAST_TEXT) -> DataFrame:
    """(doc, text): the text of each document from its page blocks: reading order, furniture off, cleaned (A4, B1).

    Documents of fewer than `least` characters are dropped.
    """
    placed = blocks.withColumn("__page", F.struct(F.col(doc).alias("d"), F.col(page).alias("p")))
    pages = reading_order(placed, "__page", width).select(F.col("__page.d").alias(doc), F.col("__page.p").alias(page), "text")
    kept = strip_repeated_lines(pages, doc, page, "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col("text").alias("t")))), lambda x: x["t"]), "\n\n")
    whole = kept.groupBy(doc).agg(joined.alias("text")).withColumn("text", clean_text(F.col("text")))
    return whole.filter(F.length("text") >= least)

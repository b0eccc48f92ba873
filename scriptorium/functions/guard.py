"""Read-only guards for graph queries and for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Words that a read-only graph query may not hold, and words it may start with.
FORBIDDEN = {
    "CREATE", "DELETE", "DETACH", "SET", "MERGE", "REMOVE", "DROP", "ALTER", "COPY", "INSTALL", "LOAD", "ATTACH", "EXPORT",
    "IMPORT", "CALL", "BEGIN", "COMMIT", "ROLLBACK", "CHECKPOINT", "USE",
}
OPENINGS = ("MATCH", "OPTIONAL", "WITH", "RETURN", "UNWIND")
ROW_LIMIT = 200
#: Plan nodes that only read; every other node of a parsed statement is rejected.
READING = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect",
    "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias",
    "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith", "Unpivot", "Values", "Window", "WithWindowDefinition",
}
#: Functions that run other code or read what no table holds.
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length"}


class UnsafeQuery(ValueError):
    """A query that is not read-only, or not understood."""


class Token(NamedTuple):
    """A lexical unit: `kind` is word, text, number, parameter or sign; `at` is where it stands."""

    kind: str
    said: str
    at: int


_LEXEMES = {
    "blank": r"\s+|//[^\n]*|/\*.*?\*/",
    "text": r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"",
    "quoted": r"`[^`]*`",
    "word": r"[A-Za-z_]\w*",
    "number": r"\d+(?:\.(?!\.)\d+)?",
    "parameter": r"\$\w+",
    "sign": r"<>|<=|>=|\.\.|.",
}
_SCANNER = re.compile("|".join(f"(?P<{kind}>{said})" for kind, said in _LEXEMES.items()), re.S)


def scan(text: str) -> Iterator[Token]:
    """The tokens of a graph query; blanks and comments are left out, quotes are taken off."""
    for found in _SCANNER.finditer(text):
        kind, said = found.lastgroup, found[0]
        if kind == "text":
            yield Token("text", re.sub(r"\\(.)", r"\1", said[1:-1]), found.start())
        elif kind == "quoted":
            yield Token("word", said[1:-1], found.start())
        elif kind != "blank":
            yield Token(kind, said, found.start())


def strip_fences(text: str) -> str:
    """What stands in the first closed code fence without its language, else the whole text; no closing semicolon."""
    lines = text.splitlines()
    fences = [n for n, line in enumerate(lines) if line.lstrip().startswith("```")]
    if len(fences) >= 2:
        text = "\n".join(lines[fences[0] + 1 : fences[1]])
    elif text.count("```") >= 2:
        inside = text[text.index("```") + 3 :]
        text = inside[: inside.index("```")]
        language, _, rest = text.lstrip().partition(" ")
        text = rest if language.lower() in ("cypher", "sql", "json") else text
    return text.strip().rstrip(";").strip()


def validate(query: str, row_limit: int = ROW_LIMIT) -> str:
    """The query without fences and with a row limit, or UnsafeQuery. Words inside literals do not count."""
    text = strip_fences(query)
    tokens = list(scan(text))
    words = [t.said.upper() for t in tokens if t.kind == "word"]
    if not tokens:
        raise UnsafeQuery("empty query")
    if bad := FORBIDDEN.intersection(words):
        raise UnsafeQuery(f"not read-only: {', '.join(sorted(bad))}")
    if tokens[0].kind != "word" or words[0] not in OPENINGS:
        raise UnsafeQuery("a query starts with " + ", ".join(OPENINGS))
    if any(t.said == ";" for t in tokens):
        raise UnsafeQuery("one query at a time")
    limited = any(a.said.upper() == "LIMIT" and b.kind == "number" for a, b in zip(tokens, tokens[1:]) if a.kind == "word")
    return text if limited else f"{text} LIMIT {row_limit}"


def _nodes(spark: SparkSession, plan) -> Iterator[tuple[bool, object]]:
    """(is a plan node, node) of every tree node of a parsed plan: children, expressions and subqueries alike."""
    kind = spark._jvm.java.lang.Class.forName
    trees, logical = "org.apache.spark.sql.catalyst.trees.TreeNode", "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
    tree, plans, product, many = kind(trees), kind(logical), kind("scala.Product"), kind("scala.collection.IterableOnce")
    stack = [plan]
    while stack:
        node = stack.pop()
        if not isinstance(node, JavaObject):
            continue
        if tree.isInstance(node):
            yield plans.isInstance(node), node
        inside = node.iterator() if many.isInstance(node) else node.productIterator() if product.isInstance(node) else None
        while inside is not None and inside.hasNext():
            stack.append(inside.next())


def check_reading(spark: SparkSession, query: str) -> None:
    """UnsafeQuery unless every node of the parsed statement only reads and no denied function is called."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    for is_plan, node in _nodes(spark, plan):
        kind = node.getClass().getName().rpartition(".")[2].rstrip("$")
        if is_plan and kind not in READING:
            raise UnsafeQuery(f"not a query: {kind}")
        if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            if (said := parts.last().lower()) in DENIED_FUNCTIONS:
                raise UnsafeQuery(f"function not allowed: {said}")


def guarded_sql(spark: SparkSession, query: str, row_limit: int = ROW_LIMIT, **args: object) -> DataFrame:
    """A read-only SQL query with named parameters: its whole parsed plan is checked, rows are always limited."""
    text = strip_fences(query)
    check_reading(spark, text)
    return spark.sql(text, args=args or None).limit(row_limit)

"""Graph patterns compiled to joins: the query surface of the graph.

A small recursive-descent parser reads MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND and RETURN; each clause is a step on a
DataFrame. A named node is two columns, its key and its label; a relation's properties are columns of its name. Hops are
equi-joins on the nodes they share. Node scans read the node table; other properties of a node are joined on demand.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.guard import ROW_LIMIT, Token, UnsafeQuery, scan, validate

_EDGE = ("rel", "src_label", "src", "dst_label", "dst")
_KEYS = ("name", "id", "key", "chunk_id", "community_id")
_AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "ORDER", "SKIP", "LIMIT"}
#: Longest variable-length path.
MOST_HOPS = 4


class _Reader:
    """Tokens with one place to read from."""

    def __init__(self, tokens: list[Token], parameters: dict[str, object]):
        self.tokens, self.at, self.parameters = tokens, 0, parameters

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else Token("end", "", -1)

    def word(self) -> str:
        """The next token as a keyword, upper-cased; empty if it is no word."""
        return self.peek().said.upper() if self.peek().kind == "word" else ""

    def take(self, *said: str) -> bool:
        """Whether the next tokens are these words or signs, which are then read."""
        for ahead, want in enumerate(said):
            token = self.peek(ahead)
            if token.kind not in ("word", "sign") or token.said.upper() != want:
                return False
        self.at += len(said)
        return True

    def need(self, *said: str) -> None:
        if not self.take(*said):
            raise UnsafeQuery(f"expected {' '.join(said)} before {self.peek().said!r}")

    def name(self) -> str:
        if self.peek().kind != "word":
            raise UnsafeQuery(f"expected a name before {self.peek().said!r}")
        self.at += 1
        return self.tokens[self.at - 1].said

    def number(self) -> int:
        if self.peek().kind != "number":
            raise UnsafeQuery(f"expected a number before {self.peek().said!r}")
        self.at += 1
        return int(float(self.tokens[self.at - 1].said))


class Graph:
    """Edges (rel, src_label, src, dst_label, dst, ...) and nodes (label, key, ...) with a pattern language over them.

    Without `nodes` the ends of the edges are the nodes.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.edges = edges
        self.extra = [c for c in edges.columns if c not in _EDGE]
        ends = edges.select(F.col("src_label").alias("label"), F.col("src").alias("key")).unionByName(edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("key")))
        self.nodes = nodes if nodes is not None else ends.distinct()

    def has_node(self, label: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of `keys` whose `key` is a node of the label."""
        return keys.join(self.nodes.filter(F.col("label") == label).select(F.col("key").alias(key)), key, "left_semi")

    def query(self, text: str, row_limit: int = ROW_LIMIT, **parameters: object) -> DataFrame:
        """The rows of a guarded read-only query; never more than `row_limit`."""
        try:
            return _Run(self, _Reader(list(scan(validate(text, row_limit))), parameters)).result(row_limit)
        except AnalysisException as error:
            raise UnsafeQuery(f"not understood: {error.getMessage()}") from error


class _Run:
    """One query: a DataFrame that grows by its clauses."""

    def __init__(self, graph: Graph, reader: _Reader):
        self.graph, self.reader = graph, reader
        self.frame: DataFrame | None = None
        self.nodes: set[str] = set()
        self.joined: set[tuple[str, str]] = set()
        self.unnamed = 0

    # ---- clauses
    def result(self, row_limit: int) -> DataFrame:
        r = self.reader
        while True:
            if r.take("OPTIONAL", "MATCH"):
                self.match(True)
            elif r.take("MATCH"):
                self.match(False)
            elif r.take("UNWIND"):
                self.unwind()
            elif r.take("WITH"):
                limit = self.project(False)
                if r.take("WHERE"):
                    self.frame = self.with_properties(self.frame, start := r.at).filter(self.condition(start))
                self.frame = self.frame if limit is None else self.frame.limit(limit)
            elif r.take("RETURN"):
                limit = self.project(True)
                if r.peek().kind != "end":
                    raise UnsafeQuery(f"not understood: {r.peek().said!r}")
                return self.frame.limit(row_limit if limit is None else min(limit, row_limit))
            else:
                raise UnsafeQuery(f"a query needs RETURN; not understood: {r.peek().said!r}")

    def match(self, optional: bool) -> None:
        r, found, new = self.reader, None, set(self.nodes)
        while True:
            step = self.path(new)
            found = step if found is None else self.meet(found, step)
            if not r.take(","):
                break
        before, base = self.nodes, self.frame
        self.nodes = new
        where = None
        if r.take("WHERE"):
            where = r.at
        if base is None:
            if where is not None:
                found = self.with_properties(found, where).filter(self.condition(where))
            self.frame = found
            return
        shared = [c for c in found.columns if c in base.columns]
        if not shared:
            raise UnsafeQuery("the patterns share no name")
        if not optional:
            joined = base.join(found, shared)
            self.frame = joined if where is None else self.with_properties(joined, where).filter(self.condition(where))
            return
        # A condition of an optional pattern decides what joins, not what stays: it is part of the join.
        both = base.distinct().join(found, shared)
        if where is not None:
            both = self.with_properties(both, where).filter(self.condition(where))
        fresh = [c for c in both.columns if c not in base.columns]
        known = {c: f"__was {n}" for n, c in enumerate(base.columns)}
        side = both.select(*[F.col(f"`{c}`").alias(k) for c, k in known.items()], *[F.col(f"`{c}`") for c in fresh])
        same = F.lit(True)
        for c, k in known.items():
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`{k}`"))
        self.frame = base.join(side, same, "left").drop(*known.values())

    def meet(self, a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns]
        if not shared:
            raise UnsafeQuery("the patterns share no name")
        return a.join(b, shared)

    def unwind(self) -> None:
        values, name = self.expression(), None
        self.reader.need("AS")
        name = self.reader.name()
        base = self.frame if self.frame is not None else self.graph.edges.sparkSession.range(1).select()
        self.frame = base.withColumn(name, F.explode(values))

    def project(self, last: bool) -> int | None:
        """WITH or RETURN with its order; the number of rows wanted."""
        r = self.reader
        if self.frame is None:
            self.frame = self.graph.edges.sparkSession.range(1).select()
        distinct = r.take("DISTINCT")
        start = r.at
        self.frame = self.with_properties(self.frame, start)
        items: list[tuple[str, Column, bool, str]] = []
        while True:
            begin = r.at
            bare = r.peek().said if r.peek().kind == "word" and r.peek(1).said != "." and r.peek(1).said != "(" else ""
            self.aggregated = False
            column, aggregated = self.expression(), False
            aggregated = self.aggregated
            said = "".join(t.said for t in r.tokens[begin : r.at])
            label = r.name() if r.take("AS") else "".join(c if c.isalnum() or c == "_" else "_" for c in said).strip("_") or "value"
            items.append((label, column, aggregated, bare if bare in self.nodes else ""))
            if not r.take(","):
                break
        carried = {} if last else {f"{label}:label": F.col(f"`{node}:label`") for label, _, _, node in items if node}
        keys = [c.alias(label) for label, c, agg, _ in items if not agg] + [c.alias(name) for name, c in carried.items()]
        aggregates = [c.alias(label) for label, c, agg, _ in items if agg]
        out = self.frame.groupBy(*keys).agg(*aggregates) if aggregates else self.frame.select(*keys)
        out = out.select(*[F.col(f"`{label}`") for label, *_ in items], *[F.col(f"`{name}`") for name in carried])
        self.frame = out.distinct() if distinct else out
        self.nodes = {label for label, _, _, node in items if node} if not last else set()
        self.joined = set()
        if r.take("ORDER", "BY"):
            orders = []
            while True:
                begin = r.at
                while r.peek().kind != "end" and r.peek().said != "," and r.word() not in ("ASC", "DESC", "ASCENDING", "DESCENDING", *_CLAUSES):
                    r.at += 1
                said = "".join(t.said for t in r.tokens[begin : r.at])
                label = "".join(c if c.isalnum() or c == "_" else "_" for c in said).strip("_")
                if label not in self.frame.columns:
                    raise UnsafeQuery(f"order by something that is not returned: {said!r}")
                down = r.take("DESC") or r.take("DESCENDING")
                if not down:
                    r.take("ASC") or r.take("ASCENDING")
                orders.append(F.desc(f"`{label}`") if down else F.asc(f"`{label}`"))
                if not r.take(","):
                    break
            self.frame = self.frame.orderBy(*orders)
        if r.take("SKIP"):
            self.frame = self.frame.offset(r.number())
        return r.number() if r.take("LIMIT") else None

    # ---- patterns
    def node(self) -> tuple[str, str | None, dict[str, Column]]:
        r = self.reader
        r.need("(")
        name = r.name() if r.peek().kind == "word" else ""
        label = r.name() if r.take(":") else None
        inline = self.inline()
        r.need(")")
        if not name:
            self.unnamed += 1
            name = f"_{self.unnamed}"
        return name, label, inline

    def inline(self) -> dict[str, Column]:
        r, out = self.reader, {}
        if r.take("{"):
            while not r.take("}"):
                key = r.name()
                r.need(":")
                out[key] = self.expression()
                r.take(",")
        return out

    def path(self, names: set[str]) -> DataFrame:
        """A chain of nodes and relations; its nodes are added to `names`."""
        r = self.reader
        left = self.node()
        names.add(left[0])
        found = None
        while r.peek().said in ("-", "<"):
            back = r.take("<")
            r.need("-")
            rels, name, low, high = [], "", 1, 1
            inline: dict[str, Column] = {}
            if r.take("["):
                if r.peek().kind == "word":
                    name = r.name()
                if r.take(":"):
                    rels.append(r.name())
                    while r.take("|"):
                        r.take(":")
                        rels.append(r.name())
                if r.take("*"):
                    low, high = 1, MOST_HOPS
                    if r.peek().kind == "number":
                        low = high = r.number()
                    if r.take(".."):
                        high = r.number() if r.peek().kind == "number" else MOST_HOPS
                    if not 1 <= low <= high <= MOST_HOPS:
                        raise UnsafeQuery(f"paths have 1 to {MOST_HOPS} hops")
                inline = self.inline()
                r.need("]")
            r.need("-")
            forth = r.take(">")
            right = self.node()
            direction = "in" if back and not forth else "out" if forth and not back else "both"
            step = self.hops(left, right, rels, direction, name, low, high, inline)
            found = step if found is None else self.meet(found, step)
            names.add(right[0])
            left = right
        if found is None:
            found = self.scan_nodes(left)
        return found

    def scan_nodes(self, node: tuple[str, str | None, dict[str, Column]]) -> DataFrame:
        name, label, inline = node
        rows = self.graph.nodes if label is None else self.graph.nodes.filter(F.col("label") == label)
        for key, value in inline.items():
            rows = rows.filter(F.col("key" if key in _KEYS and key not in rows.columns else key) == value)
        return rows.select(F.col("key").alias(name), F.col("label").alias(f"{name}:label"))

    def hops(self, a, b, rels: list[str], direction: str, name: str, low: int, high: int, inline: dict[str, Column]) -> DataFrame:
        e = self.graph.edges.filter(F.col("rel").isin(rels)) if rels else self.graph.edges
        for key, value in inline.items():
            e = e.filter(F.col(key) == value)
        mark = F.xxhash64("rel", "src_label", "src", "dst_label", "dst").alias("__edge")
        more = [F.col(c) for c in self.graph.extra] if name and high == 1 else []
        forth = e.select(F.col("src").alias("x"), F.col("src_label").alias("xl"), F.col("dst").alias("y"), F.col("dst_label").alias("yl"), "rel", mark, *more)
        back = e.select(F.col("dst").alias("x"), F.col("dst_label").alias("xl"), F.col("src").alias("y"), F.col("src_label").alias("yl"), "rel", mark, *more)
        one = forth if direction == "out" else back if direction == "in" else forth.unionByName(back.filter((F.col("x") != F.col("y")) | (F.col("xl") != F.col("yl"))))
        first = one.filter(F.col("xl") == a[1]) if a[1] else one
        ends = [F.col("x").alias(a[0]), F.col("xl").alias(f"{a[0]}:label"), F.col("y").alias(b[0]), F.col("yl").alias(f"{b[0]}:label")]
        if a[0] == b[0]:
            first, ends = first.filter("x = y and xl = yl"), ends[:2]
        if high == 1:
            rows = first.filter(F.col("yl") == b[1]) if b[1] else first
            found = rows.select(*ends, *([F.col("rel").alias(f"{name}:type"), *[F.col(c).alias(f"{name}.{c}") for c in self.graph.extra]] if name else []))
        else:
            walk = first.select("x", "xl", "y", "yl", F.array("__edge").alias("edges"))
            found = None
            step = one.select(F.col("x").alias("y"), F.col("xl").alias("yl"), F.col("y").alias("z"), F.col("yl").alias("zl"), F.col("__edge").alias("e"))
            for length in range(1, high + 1):
                if length >= low:
                    rows = walk.filter(F.col("yl") == b[1]) if b[1] else walk
                    found = rows.select(*ends) if found is None else found.unionByName(rows.select(*ends))
                if length < high:  # a path takes no relation twice
                    walk = walk.join(step, ["y", "yl"]).filter(~F.array_contains("edges", F.col("e")))
                    walk = walk.select("x", "xl", F.col("z").alias("y"), F.col("zl").alias("yl"), F.array_append("edges", F.col("e")).alias("edges"))
        for node in (a, b):
            if node[2]:
                found = found.join(self.scan_nodes(node), [node[0], f"{node[0]}:label"], "left_semi")
        return found

    # ---- expressions
    def with_properties(self, frame: DataFrame, start: int) -> DataFrame:
        """`frame` with the node properties that the clause at `start` names."""
        tokens = self.reader.tokens
        for at in range(start, len(tokens) - 2):
            said = tokens[at].said
            part = at > start and tokens[at - 1].said.upper() in ("STARTS", "ENDS")
            if tokens[at].kind == "word" and said.upper() in _CLAUSES - {"ORDER", "SKIP", "LIMIT"} and at > start and not part:
                break
            if tokens[at].kind == "word" and tokens[at + 1].said == "." and tokens[at + 2].kind == "word":
                node, prop = said, tokens[at + 2].said
                column = f"{node}.{prop}"
                if node in self.nodes and column not in frame.columns and prop in self.graph.nodes.columns and prop not in ("key", "label"):
                    side = self.graph.nodes.select(F.col("key").alias(node), F.col("label").alias(f"{node}:label"), F.col(prop).alias(column))
                    frame = frame.join(side, [node, f"{node}:label"], "left")
                    self.joined.add((node, prop))
        return frame

    def condition(self, start: int) -> Column:
        self.reader.at = start
        return self.expression()

    def expression(self) -> Column:
        out = self.conjunction()
        while self.reader.take("OR"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.reader.take("AND"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        return ~self.negation() if self.reader.take("NOT") else self.comparison()

    def comparison(self) -> Column:
        r, left = self.reader, self.sum()
        for sign, make in (("=", Column.__eq__), ("<>", Column.__ne__), ("<=", Column.__le__), (">=", Column.__ge__), ("<", Column.__lt__), (">", Column.__gt__)):
            if r.take(sign):
                return make(left, self.sum())
        if r.take("CONTAINS"):
            return left.contains(self.sum())
        if r.take("STARTS", "WITH"):
            return left.startswith(self.sum())
        if r.take("ENDS", "WITH"):
            return left.endswith(self.sum())
        if r.take("IN"):
            return F.array_contains(self.sum(), left)
        if r.take("IS", "NOT", "NULL"):
            return left.isNotNull()
        if r.take("IS", "NULL"):
            return left.isNull()
        return left

    def sum(self) -> Column:
        r, out = self.reader, self.value()
        while r.peek().said in ("+", "-", "*", "/") and r.peek().kind == "sign":
            sign = r.peek().said
            r.at += 1
            right = self.value()
            out = out + right if sign == "+" else out - right if sign == "-" else out * right if sign == "*" else out / right
        return out

    def value(self) -> Column:
        r = self.reader
        token = r.peek()
        if r.take("("):
            out = self.expression()
            r.need(")")
            return out
        if r.take("["):
            parts = []
            while not r.take("]"):
                parts.append(self.expression())
                r.take(",")
            return F.array(*parts)
        r.at += 1
        if token.kind == "text":
            return F.lit(token.said)
        if token.kind == "number":
            return F.lit(float(token.said) if "." in token.said else int(token.said))
        if token.kind == "parameter":
            if token.said[1:] not in r.parameters:
                raise UnsafeQuery(f"no value for {token.said}")
            said = r.parameters[token.said[1:]]
            return F.array(*map(F.lit, said)) if isinstance(said, (list, tuple)) else F.lit(said)
        if token.kind != "word":
            raise UnsafeQuery(f"not understood: {token.said!r}")
        if token.said.upper() in ("TRUE", "FALSE", "NULL"):
            return F.lit({"TRUE": True, "FALSE": False, "NULL": None}[token.said.upper()])
        if r.take("("):
            return self.call(token.said.lower())
        if r.take("."):
            prop = r.name()
            column = f"{token.said}.{prop}"
            key = token.said in self.nodes and prop in _KEYS and (token.said, prop) not in self.joined
            return F.col(f"`{token.said}`" if key else f"`{column}`")
        return F.col(f"`{token.said}`")

    def call(self, name: str) -> Column:
        r = self.reader
        if name in _AGGREGATES:
            self.aggregated = True
            distinct = r.take("DISTINCT")
            column = F.lit(1) if r.take("*") else self.expression()
            r.need(")")
            if name == "count":
                return F.count_distinct(column) if distinct else F.count(column)
            if name == "collect":
                return F.array_sort(F.collect_set(column) if distinct else F.collect_list(column))
            return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](column)
        args = []
        while not r.take(")"):
            args.append(self.expression())
            r.take(",")
        simple = {"tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "size": F.size, "trim": F.trim, "abs": F.abs, "coalesce": F.coalesce, "round": F.round}
        if name not in simple:
            raise UnsafeQuery(f"function not known: {name}")
        return simple[name](*args)

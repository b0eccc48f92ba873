"""Typed property graph with provenance: schema, build, counts, neighbourhoods.

Nodes are rows (label, key, properties), edges rows (rel, src_label, src, dst_label, dst, properties). A build reads the
accepted records of the extraction log, resolves every end through the alias map of names, aliases, configuration and
merges, and overwrites what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.tokens import strip
from scriptorium.operators.resolution import endpoint_key, merged_aliases
from scriptorium.sources.tables import broadcast_if_small, durable, hinted, measured_once

#: Which labels each relation may join.
SIGNATURES = [
    ("AUTHORED_BY", "Paper", "Author"), ("AFFILIATED_WITH", "Author", "Institution"), ("ADDRESSES", "Paper", "Task"),
    ("PROPOSES", "Paper", "Method"), ("USES", "Paper", "Method"), ("USES", "Paper", "Dataset"), ("USES", "Method", "Dataset"),
    ("EVALUATES_ON", "Paper", "Dataset"), ("EVALUATES_ON", "Method", "Dataset"), ("REPORTS", "Paper", "Metric"),
    ("BUILDS_ON", "Method", "Method"), ("COMPARES_TO", "Method", "Method"),
]
#: Key and properties of each label, then properties of relations beside their provenance.
NODE_TABLES = {
    "Paper": ("id", ["title STRING", "abstract STRING", "published DATE", "categories STRING"]), "Author": ("name", ["aliases STRING"]),
    "Institution": ("name", ["aliases STRING"]), "Task": ("name", ["description STRING", "aliases STRING"]),
    "Method": ("name", ["description STRING", "aliases STRING"]), "Dataset": ("name", ["description STRING", "aliases STRING"]),
    "Metric": ("name", ["aliases STRING"]), "Chunk": ("chunk_id", ["paper_id STRING", "char_start BIGINT", "char_end BIGINT", "section STRING"]),
    "Community": ("community_id", ["level BIGINT", "title STRING", "summary STRING", "size BIGINT"]),
}
PROVENANCE = ["window_id STRING", "char_start BIGINT", "char_end BIGINT", "evidence STRING", "confidence DOUBLE"]
RELATION_PROPERTIES = {"AUTHORED_BY": ["ordinal BIGINT"], "REPORTS": ["value DOUBLE", "dataset STRING", "method STRING"]}
#: Labels that a member of a community is looked up in, in order.
MEMBER_LABELS = ["Method", "Dataset", "Task", "Author", "Paper"]
#: Relations that make communities, in the order their text is written.
THEMATIC = ["EVALUATES_ON", "USES", "PROPOSES", "BUILDS_ON", "COMPARES_TO", "ADDRESSES"]
EXTRACTABLE = ["Author", "Institution", "Task", "Method", "Dataset", "Metric"]
EVIDENCE_LENGTH, PROPERTY_LENGTH, ABSTRACT_LENGTH = 2000, 200, 4000


def schema_ddl() -> list[str]:
    """CREATE TABLE statements, node tables before relation tables; existing tables stay."""
    nodes = [f"CREATE TABLE IF NOT EXISTS node_{label.lower()} ({', '.join([f'{key} STRING', *props])}) USING parquet" for label, (key, props) in NODE_TABLES.items()]
    names = [*dict.fromkeys(rel for rel, _, _ in SIGNATURES), "MENTIONED_IN", "IN_COMMUNITY"]
    ends = ["src_label STRING", "src STRING", "dst_label STRING", "dst STRING"]
    plain = ("MENTIONED_IN", "IN_COMMUNITY")
    return nodes + [f"CREATE TABLE IF NOT EXISTS rel_{r.lower()} ({', '.join(ends + ([] if r in plain else PROVENANCE + RELATION_PROPERTIES.get(r, [])))}) USING parquet" for r in names]


def schema_text() -> str:
    """What a prompt has to know of the graph: labels with key and properties, relations with ends and properties."""
    named = lambda props: ", ".join(p.split(" ")[0] for p in props)
    labels = [f"{label}: key {key}; {named(props)}" for label, (key, props) in NODE_TABLES.items()]
    ends: dict[str, list[str]] = {}
    for rel, a, b in [*SIGNATURES, *(("IN_COMMUNITY", label, "Community") for label in MEMBER_LABELS)]:
        ends.setdefault(rel, []).append(f"({a})->({b})")
    own = {rel: named([*RELATION_PROPERTIES.get(rel, []), *([] if rel == "IN_COMMUNITY" else PROVENANCE)]) for rel in ends}
    relations = [f"{rel}: {' '.join(pairs)}" + (f"; {own[rel]}" if own[rel] else "") for rel, pairs in ends.items()]
    return "\n".join(["Labels", *labels, "Relations", *relations])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows merged on `key`: a property of `new` replaces the old one unless it is null, empty or an empty list."""
    names = [c for c in old.columns if c != key]
    filled = lambda df, n: df.select(key, F.lit(n).alias("__seq"), *[_filled(df, c) for c in names])
    both = filled(old, 0).unionByName(filled(new, 1))
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c) for c in names])


def _filled(df: DataFrame, name: str):
    kind = df.schema[name].dataType.typeName()
    column = F.col(name)
    if kind == "string":
        return F.nullif(column, F.lit("")).alias(name)
    if kind == "array":
        return F.when(F.size(column) > 0, column).alias(name)
    return column


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """`existing` without the rows of the incoming keys, plus `incoming`."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def paper_nodes(papers: DataFrame) -> DataFrame:
    """Paper nodes: abstract cut, categories joined; the row loaded last with a filled property wins."""
    order = F.col("ingested_at")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    one = papers.groupBy("paper_id").agg(last("title"), last("abstract"), last("categories"))
    return one.select(F.col("paper_id").alias("id"), "title", F.substring("abstract", 1, ABSTRACT_LENGTH).alias("abstract"), F.array_join("categories", ", ").alias("categories"))


def authored_by(papers: DataFrame) -> DataFrame:
    """(src, dst, ordinal) of the authors of each paper, distinct rows."""
    return papers.select(F.col("paper_id").alias("src"), F.posexplode("authors").alias("ordinal", "dst")).filter("dst is not null").distinct()


def authored_edges(papers: DataFrame) -> DataFrame:
    """AUTHORED_BY edges (G7): one for each author of a paper at the first place it stands, certain by their source."""
    first = authored_by(papers).filter("dst <> '' and src is not null").groupBy("src", "dst").agg(F.min("ordinal").cast("bigint").alias("ordinal"))
    return first.select(
        F.lit("AUTHORED_BY").alias("rel"), F.lit("Paper").alias("src_label"), "src", F.lit("Author").alias("dst_label"), "dst",
        F.lit("paper metadata").alias("evidence"), F.lit(1.0).alias("confidence"), "ordinal",
    )


def entity_nodes(aliases: DataFrame) -> DataFrame:
    """(label, key, aliases) of the named entities (G8): their keys in order, joined; papers are no named entities."""
    named = aliases.filter(F.col("type").isin(EXTRACTABLE)).groupBy(F.col("type").alias("label"), F.col("canonical").alias("key"))
    return named.agg(F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("aliases"))


def relations(log: DataFrame) -> DataFrame:
    """One row for each relation of the accepted records, with its place in the log."""
    return log.select("seq", "window_id", "paper_id", "char_start", "char_end", F.posexplode("relations").alias("rel_no", "r")).select(
        "seq", "rel_no", "window_id", "paper_id", "char_start", "char_end", "r.subject", "r.predicate", "r.object",
        F.substring("r.evidence", 1, EVIDENCE_LENGTH).alias("evidence"), "r.confidence",
    )


def resolved_relations(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """`relations` with both ends resolved strictly: (…, name_s, label_s, name_o, label_o), null where an end is unknown.

    Ends are looked up by `endpoint_key` in `aliases` (key, canonical, type). The alias side is broadcast where it is few
    bytes (measured); beyond that AQE splits the shuffled join at ends that many relations share.
    """
    table = measured_once(aliases)
    side = lambda n: table.select(F.col("key").alias(f"k_{n}"), F.col("canonical").alias(f"name_{n}"), F.col("type").alias(f"label_{n}"))
    keyed = rows.withColumn("k_s", endpoint_key("subject")).withColumn("k_o", endpoint_key("object"))
    return keyed.join(hinted(side("s"), table), "k_s", "left").join(hinted(side("o"), table), "k_o", "left")


def typed_edges(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges of relations with both ends resolved strictly, the first of equal ones, with an allowed signature.

    A Paper-typed end becomes the record's paper. Edges are deduplicated before the signature is checked.
    """
    return _signed(_first_edges(resolved_relations(rows, aliases))).select(
        F.col("predicate").alias("rel"), F.col("label_s").alias("src_label"), "src", F.col("label_o").alias("dst_label"), "dst",
        "window_id", "char_start", "char_end", "evidence", F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
    )


def _first_edges(both: DataFrame) -> DataFrame:
    """Relations with two known ends and a predicate, the first of equal (predicate, src, dst)."""
    end = lambda n: F.when(F.col(f"label_{n}") == "Paper", F.col("paper_id")).otherwise(F.col(f"name_{n}"))
    named = both.withColumn("src", end("s")).withColumn("dst", end("o")).filter("predicate <> '' and src is not null and dst is not null")
    place = F.struct("seq", "rel_no", "window_id")
    rest = [c for c in named.columns if c not in ("predicate", "src", "dst")]
    # The least place is found by a partial aggregate before the shuffle, so an edge that many windows say is no hot group.
    one = named.groupBy("predicate", "src", "dst").agg(F.min_by(F.struct(*rest), place).alias("first"))
    return one.select("predicate", "src", "dst", "first.*")


def _signed(edges: DataFrame) -> DataFrame:
    allowed = edges.sparkSession.createDataFrame(SIGNATURES, "predicate string, label_s string, label_o string")
    return edges.join(F.broadcast(allowed), ["predicate", "label_s", "label_o"])


def reports_edges(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """REPORTS edges of claims (paper_id, window_id, method, dataset, metric, value, evidence).

    Claims without a metric are dropped, the others are not deduplicated; method and dataset are resolved leniently (F11)
    and cut; a null value is 0.
    """
    table = measured_once(aliases)
    said = claims.withColumn("metric", strip(F.col("metric"))).filter("metric <> '' and paper_id is not null")
    for column in ("method", "dataset"):
        side = hinted(table.select(F.col("key").alias(f"k_{column}"), F.col("canonical").alias(f"c_{column}")), table)
        said = said.withColumn(f"k_{column}", endpoint_key(column)).join(side, f"k_{column}", "left")
        said = said.withColumn(column, F.substring(F.coalesce(f"c_{column}", strip(F.col(column)), F.lit("")), 1, PROPERTY_LENGTH))
    return said.select(
        F.lit("REPORTS").alias("rel"), F.lit("Paper").alias("src_label"), F.col("paper_id").alias("src"), F.lit("Metric").alias("dst_label"), F.col("metric").alias("dst"),
        "window_id", F.substring(F.coalesce("evidence", F.lit("")), 1, EVIDENCE_LENGTH).alias("evidence"), F.lit(1.0).alias("confidence"),
        F.coalesce("value", F.lit(0.0)).alias("value"), "dataset", "method",
    )


def build_graph(papers: DataFrame, log: DataFrame, entities: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of accepted records.

    Nodes: papers, their authors, the named entities, the metrics of claims; one row (label, key) with the filled
    properties. Edges: AUTHORED_BY, the relations, REPORTS. Summary: entities, relations written and relations dropped:
    an unknown end, no predicate or no metric, an end that is no node, or a signature that is not allowed; repeats are neither.
    Edges and summary are plans: a caller that reads one more than once stores it first.
    """
    aliases = broadcast_if_small(merged_aliases(entities))
    both = resolved_relations(relations(log), aliases)
    first = _first_edges(both)
    said = _signed(first).select(
        F.col("predicate").alias("rel"), F.col("label_s").alias("src_label"), "src", F.col("label_o").alias("dst_label"), "dst",
        "window_id", "char_start", "char_end", "evidence", F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
    )
    metadata, reports = authored_edges(papers), reports_edges(claims, aliases)
    text = lambda name: F.lit(None).cast("string").alias(name)
    paper = paper_nodes(papers).select(F.lit("Paper").alias("label"), F.col("id").alias("key"), text("aliases"), "title", "abstract", "categories")
    wide = lambda df, aliases: df.select("label", "key", aliases, text("title"), text("abstract"), text("categories"))
    named = entity_nodes(aliases)
    others = metadata.select(F.col("dst_label").alias("label"), F.col("dst").alias("key")).unionByName(reports.select(F.col("dst_label").alias("label"), F.col("dst").alias("key")))
    every = paper.unionByName(wide(named, F.col("aliases"))).unionByName(wide(others, text("aliases"))).filter("key is not null")
    nodes = durable(every.groupBy("label", "key").agg(*[F.max(c).alias(c) for c in ("aliases", "title", "abstract", "categories")]))
    edges = metadata.unionByName(said, allowMissingColumns=True).unionByName(reports, allowMissingColumns=True)
    for end in ("src", "dst"):  # an edge joins nodes that are there (G2)
        edges = edges.join(nodes.select(F.col("label").alias(f"{end}_label"), F.col("key").alias(end)), [f"{end}_label", end], "left_semi")
    edges = edges.select("rel", "src_label", "src", "dst_label", "dst", *[c for c in edges.columns if c not in ("rel", "src_label", "src", "dst_label", "dst")])
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    summary = (
        one(named, "canonical_entities")
        .crossJoin(one(edges.filter("rel <> 'AUTHORED_BY'"), "relations_written"))
        .crossJoin(one(both.filter("coalesce(predicate, '') = '' or name_s is null or name_o is null"), "unknown"))
        .crossJoin(one(first, "kept")).crossJoin(one(claims, "claims"))
    )
    dropped = F.col("unknown") + F.col("kept") + F.col("claims") - F.col("relations_written")
    return nodes, edges, summary.select("canonical_entities", "relations_written", dropped.alias("relations_dropped"))


def member_edges(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """IN_COMMUNITY edges of members (community, node): the first of MEMBER_LABELS that has a node of the name (H5)."""
    place = F.array_position(F.array(*[F.lit(label) for label in MEMBER_LABELS]), F.col("label"))
    known = members.join(nodes.filter(F.col("label").isin(MEMBER_LABELS)).select("label", F.col("key").alias("node")), "node")
    first = known.groupBy("community", "node").agg(F.min_by("label", place).alias("src_label"))
    return first.select(F.lit("IN_COMMUNITY").alias("rel"), "src_label", F.col("node").alias("src"), F.lit("Community").alias("dst_label"), F.col("community").alias("dst"))


def answer_subgraph(edges: DataFrame, names: list[str], each: int = 5, most_names: int = 4, most: int = 120) -> DataFrame:
    """(name, rel, source, target): for each of the first names up to `each` edges with an end that contains it."""
    seeds = edges.sparkSession.createDataFrame([(n, name) for n, name in enumerate(names[:most_names])], "n int, name string")
    near = F.lower("src").contains(F.lower("name")) | F.lower("dst").contains(F.lower("name"))
    met = edges.select("rel", F.col("src").alias("source"), F.col("dst").alias("target"), "src", "dst").join(F.broadcast(seeds), near).drop("src", "dst").distinct()
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("rel", "source", "target"))).filter(F.col("r") <= each)
    return ranked.orderBy("n", "r").limit(most).select("name", "rel", "source", "target")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): rows of each label and each relation."""
    return (
        nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(edges.groupBy(F.concat(F.lit("-[:"), F.col("rel"), F.lit("]->")).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    )


def edge_weights(edges: DataFrame, src: str, dst: str, confidence: str) -> DataFrame:
    """(a, b, weight), a < b: undirected projection; a null or zero confidence counts 1."""
    one = F.coalesce(F.nullif(F.col(confidence), F.lit(0.0)), F.lit(1.0))
    ends = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), one.alias("w"))
    return ends.filter("a is not null and b is not null and a <> b and a <> ''").groupBy("a", "b").agg(F.sum("w").alias("weight"))


def modularity(weights: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a partition (node, community) of weighted undirected edges (a, b, weight)."""
    label = lambda n: membership.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}"))
    both = weights.join(label("a"), "a").join(label("b"), "b")
    total = weights.agg(F.sum("weight").alias("m"))
    inside = both.filter("c_a = c_b").groupBy(F.col("c_a").alias("c")).agg(F.sum("weight").alias("w_in"))
    degree = both.select(F.col("c_a").alias("c"), "weight").unionByName(both.select(F.col("c_b").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("deg"))
    parts = degree.join(inside, "c", "left").crossJoin(F.broadcast(total))
    term = F.coalesce("w_in", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("deg") / (2 * F.col("m")), 2)
    return parts.agg(F.sum(term).alias("modularity"))


def neighbourhood(edges: DataFrame, seed: str, depth: int = 1, limit: int | None = None) -> DataFrame:
    """Distinct (source, target) within `depth` hops, either way, of nodes whose name contains `seed` in any case."""
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    one = both.filter(F.lower("src").contains(seed.lower()))
    found = one.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    if depth == 2:
        near = one.select(F.col("src").alias("source"), F.col("dst").alias("middle"))
        found = found.unionByName(near.join(both, F.col("middle") == F.col("src")).filter("dst <> source").select("source", F.col("dst").alias("target")))
    found = found.distinct()
    return found if limit is None else found.orderBy("source", "target").limit(limit)


def community_context(members: DataFrame, edges: DataFrame, most_members: int = 60, most_relations: int = 80) -> DataFrame:
    """(community, context): up to `most_members` names and `most_relations` relation lines among them, in a fixed order."""
    shown = members.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("node"))).filter(F.col("n") <= most_members)
    side = lambda n: shown.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}"))
    place = F.array_position(F.array(*[F.lit(r) for r in THEMATIC]), F.col("rel"))
    lines = edges.filter(F.col("rel").isin(THEMATIC)).join(side("src"), "src").join(side("dst"), "dst").filter("c_src = c_dst")
    lines = lines.select(F.col("c_src").alias("community"), place.alias("place"), F.concat_ws(" ", "src", "rel", "dst").alias("line")).distinct()
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("place", "line"))).filter(F.col("n") <= most_relations)
    said = lambda df, col: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", col))), lambda x: x[col]), "\n")
    names = shown.groupBy("community").agg(said(shown, "node").alias("names"))
    told = lines.groupBy("community").agg(said(lines, "line").alias("lines"))
    return names.join(told, "community", "left").select("community", F.concat_ws("\n\n", "names", "lines").alias("context"))

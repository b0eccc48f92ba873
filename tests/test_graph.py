import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.guard import FORBIDDEN, UnsafeQuery, guarded_sql, strip_fences, validate
from scriptorium.operators import communities, graph, resolution
from scriptorium.operators.components import connected_components
from scriptorium.operators.match import Graph
from scriptorium.plans import reference


def norm(spark, *names):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    return [r.f for r in rows.select("i", resolution.normal_form(F.col("n")).alias("f")).orderBy("i").collect()]


def test_normal_forms(spark):
    same = [("Dense Passage Retriever", "Dense Passage Retrieval"), ("BERT model", "BERT"), ("Natural Questions", "Natural Question"), ("Retrieval-Augmented Generation", "retrieval augmented generation")]
    assert all(len(set(norm(spark, *pair))) == 1 for pair in same)
    assert norm(spark, "Natural Questions", "TriviaQA", "models", "Method model", "classes", "queries", "Optimiser (x)", None, "", "ing") == ["natur quest", "triviaqa", "model", "method", "classe", "querie", "optimis", None, "", "ing"]


@pytest.mark.parametrize(
    "name,plain",
    [("DPR (rt, NQ, 1enc)", "DPR"), ("DPR (rt, NQ, 1enc) + qsft", "DPR"), ("DHR-D(Abs)+T", "DHR-D"), ("D-NET (Baidu)", "D-NET"), ("BERT base baseline (MRQA Organizers)", "BERT base baseline"),
     ("BM25 + DPR", "BM25 + DPR"), ("(only)", "(only)"), ("AB (x)", "AB (x)"), ("Yang et al. (2018)", "Yang et al. (2018)"), ("DPR", "DPR"), ("  DPR (a) (b) ", "DPR"),
     ("AB (x)+T", "AB (x)"), ("X (2019) + y", "X (2019) + y"), ("Net (a)+b (c)", "Net"), ("Net (a)+b+c", "Net (a)+b+c"), ("Net (1999)(small)", "Net (1999)"), ("ABC(d)", "ABC")],
)
def test_strip_config(spark, name, plain):
    assert spark.createDataFrame([(name,)], "n string").select(resolution.strip_config(F.col("n"))).first()[0] == plain


def test_resolution_end_to_end(spark):
    names = [
        ("Method", "Dense Passage Retriever"), ("Method", "Dense Passage Retrieval"), ("Method", "BM25"), ("Dataset", "SQuAD v1.1"), ("Dataset", "SQuAD 2.0"),
        ("Dataset", "2Wiki-MultiHopQA"), ("Dataset", "2WikiMultihopQA"), ("Dataset", None), ("Method", "SQuAD v1.1"),
    ]
    got = {(r.type, r.name): r.canonical for r in resolution.resolve_entities(spark.createDataFrame(names + names[:2], "type string, name string")).collect()}
    assert len(got) == 8
    assert got["Method", "Dense Passage Retriever"] == got["Method", "Dense Passage Retrieval"]
    assert got["Dataset", "SQuAD v1.1"] != got["Dataset", "SQuAD 2.0"]
    assert got["Dataset", "2Wiki-MultiHopQA"] == got["Dataset", "2WikiMultihopQA"]


def test_alias_map_and_endpoints(spark):
    rows = [("Dense Passage Retriever", "Method", ["DPR", "x"]), ("DPR (large)", "Method", None), ("+ (ft)", "Method", ["DPR"]), ("NQ", "Dataset", [])]
    aliases = resolution.alias_map(spark.createDataFrame(rows, "name string, type string, aliases array<string>"))
    got = {r.key: (r.canonical, r.type) for r in aliases.collect()}
    assert got["dpr"] == ("Dense Passage Retriever", "Method") and got["nq"] == ("NQ", "Dataset") and "+" not in got
    ends = spark.createDataFrame([("dpr",), ("unknown",), ("",), (None,)], "m string")
    assert [r.out for r in resolution.resolve_endpoint(ends, "m", aliases, "out").collect()] == ["Dense Passage Retriever"]
    assert {r.out for r in resolution.resolve_endpoint(ends, "m", aliases, "out", strict=False).collect()} == {"Dense Passage Retriever", "unknown", ""}


def test_communities_are_of_resolved_names(spark, tmp_path):
    entities = [("Dense Passage Retriever", "Method", ["DPR"]), ("Dense Passage Retrieval", "Method", None), ("Harbor QA", "Dataset", None), ("Tundra", "Dataset", None), ("Nightjar", "Method", None)]
    spark.createDataFrame(entities, "name string, type string, aliases array<string>").write.parquet(f"{tmp_path}/entities.parquet")
    said = [("DPR (large)", "EVALUATES_ON", "harbor qa"), ("Dense Passage Retrieval", "EVALUATES_ON", "Harbor QA"), ("dense passage retriever", "USES", "Tundra"), ("Nightjar", "BUILDS_ON", "ghost")]
    rows = [(1, "w", "p", 0, 9, "ok", None, [(a, r, b, "e", 0.5) for a, r, b in said], None)]
    spark.createDataFrame(rows, "seq bigint, window_id string, paper_id string, char_start int, char_end int, status string, error string, relations array<struct<subject string, predicate string, object string, evidence string, confidence double>>, logged_at timestamp").write.parquet(f"{tmp_path}/extractions.parquet")
    spark.createDataFrame([("p", "T", None, None, None, 1)], "paper_id string, title string, authors array<string>, abstract string, categories array<string>, ingested_at int").write.parquet(f"{tmp_path}/papers.parquet")
    spark.createDataFrame([], "claim_id bigint, window_id string, paper_id string, method string, dataset string, metric string, value double, evidence string").write.parquet(f"{tmp_path}/result_claims.parquet")
    edges = reference._graph(spark, str(tmp_path))[1].collect()
    assert sorted((r.src, r.rel, r.dst) for r in edges) == [("Dense Passage Retriever", "EVALUATES_ON", "Harbor QA"), ("Dense Passage Retriever", "USES", "Tundra")]
    assert {r.node for r in reference.community_members(spark, str(tmp_path)).collect()} == {"Dense Passage Retriever", "Harbor QA", "Tundra"}


def test_every_type_is_resolved(spark, data):
    names = reference.read_table(spark, data, "entities").filter(resolution.valid_name(F.col("name"))).select("type", F.trim("name").alias("name")).filter("type is not null")
    got = reference.entity_resolution(spark, data)
    assert {tuple(r) for r in got.select("type", "name").collect()} == {tuple(r) for r in names.collect()}
    assert {"Author", "Institution"} <= {r.type for r in got.select("type").distinct().collect()}


@pytest.mark.parametrize("one_task_bytes", [None, 0])
def test_components(spark, one_task_bytes):
    edges = [("b", "a"), ("b", "c"), ("d", "e"), ("x", "x"), (None, "a"), ("c", "b")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), one_task_bytes=one_task_bytes).collect()}
    assert got["c"] == "a" and got["e"] == "d" and "x" not in got and {got[f"n{i:02}"] for i in range(41)} == {"n00"}
    assert connected_components(spark.createDataFrame([], "a string, b string"), one_task_bytes=one_task_bytes).count() == 0


CLUSTER = [("1", "2"), ("2", "3"), ("3", "1"), ("1", "4"), ("4", "2")]
WEIGHTS = "a string, b string, weight double"


@pytest.mark.parametrize("one_task_bytes", [None, 0])
def test_two_clusters(spark, one_task_bytes):
    edges = [(c + a, c + b, 1.0) for c in "ab" for a, b in CLUSTER] + [("a1", "b1", 1.0), ("a1", "a1", 1.0)]
    found = communities.detect_communities(spark.createDataFrame(edges, WEIGHTS), one_task_bytes=one_task_bytes)
    groups: dict = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a1", "a2", "a3", "a4"], ["b1", "b2", "b3", "b4"]]
    weights = spark.createDataFrame(edges[:-1], WEIGHTS)
    good = graph.modularity(weights, found.select("node", "community")).first()[0]
    assert good > graph.modularity(weights, found.select("node", F.lit("one").alias("community"))).first()[0]
    assert communities.detect_communities(spark.createDataFrame([("x", "y", 1.0)], WEIGHTS), one_task_bytes=one_task_bytes).count() == 0
    assert communities.detect_communities(spark.createDataFrame([], WEIGHTS), one_task_bytes=one_task_bytes).count() == 0


def test_hubs_keep_all_their_leaves(spark):
    edges = [(h, f"{h}{i:04}", 1.0) for h in ("m", "n") for i in range(800)] + [("m", "n", 1.0)]
    found = communities.detect_communities(spark.createDataFrame(edges, WEIGHTS))
    assert sorted((r.community, r.n) for r in found.groupBy("community").agg(F.count(F.lit(1)).alias("n")).collect()) == [("m", 801), ("n", 801)]


def planted(rng, groups="abcd", size=30, inner=5, outer=20):
    edges = {(f"{c}{a:02}", f"{c}{b:02}"): 1.0 for c in groups for a in range(size) for b in rng.sample(range(size), inner) if a < b}
    edges |= {(f"{rng.choice(groups[:2])}{rng.randrange(size):02}", f"{rng.choice(groups[2:])}{rng.randrange(size):02}"): 0.5 for _ in range(outer)}
    return edges


def in_arrays(edges):
    names = np.array(sorted({n for e in edges for n in e}))
    code = {n: i for i, n in enumerate(names)}
    x, y = (np.array([code[e[i]] for e in edges]) for i in (0, 1))
    return names, np.minimum(x, y), np.maximum(x, y), np.array(list(edges.values()))


def modularity_of(edges, own):
    degree, total, inside = Counter(), sum(edges.values()), 0.0
    for (a, b), w in edges.items():
        degree[own[a]] += w
        degree[own[b]] += w
        inside += w * (own[a] == own[b])
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def test_rounds_end_where_no_move_gains():
    edges = planted(random.Random(3))
    names, x, y, w = in_arrays(edges)
    k = np.bincount(x, w, len(names)) + np.bincount(y, w, len(names))
    own = np.arange(len(names))
    communities._move_arrays(np.arange(len(names)), x, y, w, own, k, k.sum(), 1.0, False, names)
    for node in range(len(names)):
        worth = lambda c: sum(v for i, j, v in zip(x, y, w) for n, o in ((i, j), (j, i)) if n == node and own[o] == c) - k[node] / k.sum() * sum(k[o] for o in range(len(names)) if own[o] == c and o != node)  # noqa: B023, E731
        assert all(worth(c) <= worth(own[node]) + 1e-8 for c in set(own))


def test_communities_are_connected_and_not_below_single_moves():
    for seed in range(6):
        edges = planted(random.Random(seed), inner=3, outer=60)
        names, x, y, w = in_arrays(edges)
        own = communities._leiden_arrays(x, y, w, names, 1.0)
        for c in set(own):
            inside, seen = set(np.flatnonzero(own == c)), set()
            stack = [min(inside)]
            while stack:
                n = stack.pop()
                if n not in seen:
                    seen.add(n)
                    stack += [o for i, j in zip(x, y) for m, o in ((i, j), (j, i)) if m == n and o in inside]
            assert seen == inside
        single = np.arange(len(names))
        k = np.bincount(x, w, len(names)) + np.bincount(y, w, len(names))
        communities._move_arrays(np.arange(len(names)), x, y, w, single, k, k.sum(), 1.0, False, names)
        labels = lambda found: {n: found[i] for i, n in enumerate(names)}  # noqa: B023, E731
        truth = {n: n[0] for n in names}
        assert modularity_of(edges, labels(own)) >= max(modularity_of(edges, labels(single)), modularity_of(edges, truth) - 0.02)


@pytest.mark.parametrize("seed", [1])
def test_one_task_and_rounds_find_the_same(spark, seed):
    edges = planted(random.Random(seed), groups="abcd", size=10, inner=3, outer=8)
    frame = spark.createDataFrame([(*e, w) for e, w in edges.items()], WEIGHTS)
    one, many = ({(r.node, r.community, r.size) for r in communities.detect_communities(frame, least_members=1, one_task_bytes=n).collect()} for n in (None, 0))
    assert one == many and len(one) == len({n for e in edges for n in e})


def test_summaries_and_tables(spark):
    class Model:
        def parse(self, system, user, fields, max_tokens):
            if "bad" in user:
                raise RuntimeError("no")
            return {"title": user.split()[0], "summary": "all of it"}

    contexts = spark.createDataFrame([("c1", 3, "bad one"), ("c2", 5, "dense retrieval")], "community string, size int, context string")
    summaries = communities.summarise_communities(contexts, Model)
    members = spark.createDataFrame([(f"n{i}", "c1", 3) for i in range(3)] + [(f"m{i}", "c2", 5) for i in range(5)] + [("z", "c0", 3)], "node string, community string, size int")
    got = communities.load_communities(communities.community_nodes(members, summaries)).collect()
    assert [(r.community_id, r.title, r.summary, r.size) for r in got] == [("c2", "dense", "all of it", 5), ("c0", "", "", 3), ("c1", "Cluster of 3 entities", "", 3)]


EDGES = [("USES", "Method", "MossRank", "Dataset", "Harbor QA", 1.0), ("USES", "Method", "Lantern", "Dataset", "Harbor QA", 0.0), ("BUILDS_ON", "Method", "Lantern", "Method", "MossRank", 0.5)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "rel string, src_label string, src string, dst_label string, dst string, confidence double")


def test_patterns(edges):
    g = Graph(edges)
    got = g.query("MATCH (m:Method)-[:USES]->(d:Dataset) WHERE toLower(d.name) CONTAINS 'harbor' RETURN d.name AS d, count(DISTINCT m.name) AS n")
    assert [tuple(r) for r in got.collect()] == [("Harbor QA", 2)]
    got = g.query("MATCH (a:Method)-[:USES]->(d) OPTIONAL MATCH (a)-[r:BUILDS_ON]->(b) RETURN DISTINCT a.name AS a, b.name AS b ORDER BY a")
    assert [tuple(r) for r in got.collect()] == [("Lantern", "MossRank"), ("MossRank", None)]
    assert g.query("MATCH (a)<-[r:BUILDS_ON]-(b) RETURN a.name AS a, r.confidence AS c").first().c == 0.5
    got = g.query("MATCH (a)-[:USES]->(), (a)-[:BUILDS_ON]->() RETURN a.name AS a")
    assert [tuple(r) for r in got.collect()] == [("Lantern",)]
    with pytest.raises(UnsafeQuery):
        g.query("MATCH (a) DELETE a")
    assert graph.neighbourhood(edges, "lantern", 2).count() == 2
    weights = {(r.a, r.b): r.weight for r in graph.edge_weights(edges, "src", "dst", "confidence").collect()}
    assert weights["Harbor QA", "Lantern"] == 1.0 and weights["Lantern", "MossRank"] == 0.5


def test_guard(spark):
    for word in FORBIDDEN:
        for said in (word, word.lower()):
            with pytest.raises(UnsafeQuery):
                validate(f"MATCH (n) {said} n")
    for bad in ("", "EXPLAIN MATCH (n) RETURN n", "CALL db.x()", "MATCH (n) RETURN n; DROP TABLE x"):
        with pytest.raises(UnsafeQuery):
            validate(bad)
    assert validate("MATCH (n) WHERE n.name = 'CREATE-Bench' RETURN n").endswith("LIMIT 200")
    assert validate("MATCH (n) RETURN n LIMIT 5;") == "MATCH (n) RETURN n LIMIT 5"
    assert strip_fences("```cypher\nMATCH (n) RETURN n;\n```") == "MATCH (n) RETURN n"
    assert guarded_sql(spark, "SELECT :a + 1 AS b", a=1).first().b == 2
    assert validate("```cypher\nMATCH (n) RETURN n\n```") == "MATCH (n) RETURN n LIMIT 200"
    assert [strip_fences(x) for x in ("```\nMATCH (n) RETURN n\n```", "MATCH (n) RETURN n;", "text ```sql SELECT 1``` more")] == ["MATCH (n) RETURN n", "MATCH (n) RETURN n", "SELECT 1"]
    good = "WITH t AS (SELECT id AS k FROM range(5)) SELECT k, count(*) AS n FROM t WHERE k IN (SELECT 1) OR EXISTS (SELECT 2) GROUP BY k HAVING n > 0 ORDER BY k"
    assert guarded_sql(spark, good).count() == 5
    for bad in ("DROP TABLE x", "CREATE VIEW v AS SELECT 1", "CACHE TABLE x", "SET a=b", "INSERT INTO x VALUES (1)", "TRUNCATE TABLE x", "LOAD DATA INPATH 'a' INTO TABLE x", "MSCK REPAIR TABLE x", "REFRESH TABLE x",
                "ANALYZE TABLE x COMPUTE STATISTICS", "UNCACHE TABLE x", "COMMENT ON TABLE x IS 'y'", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "FROM x INSERT INTO a SELECT * INSERT INTO b SELECT *",
                "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM (SELECT java_method('java.lang.System', 'nanoTime')) WHERE 1 IN (SELECT 2)", "SELECT 1 WHERE EXISTS (SELECT reflect('a', 'b'))", "EXPLAIN SELECT 1", "SHOW TABLES", "ADD JAR x", "USE x"):
        with pytest.raises(UnsafeQuery):
            guarded_sql(spark, bad)


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", "x", ["p"]), ("b", "y", None)], "k string, t string, l array<string>")
    new = spark.createDataFrame([("a", "", []), ("b", "z", ["q"]), ("c", None, None)], "k string, t string, l array<string>")
    assert {r.k: (r.t, r.l) for r in graph.upsert(old, new, "k").collect()} == {"a": ("x", ["p"]), "b": ("z", ["q"]), "c": (None, None)}
    assert {(r.k, r.t) for r in graph.replace_by_key(old, new.filter("k = 'a'"), "k").collect()} == {("a", ""), ("b", "y")}


REL = "seq bigint, rel_no int, window_id string, paper_id string, char_start int, char_end int, subject string, predicate string, object string, evidence string, confidence double"


def test_typed_edges_check_signature_and_duplicates(spark):
    rows = [(1, 0, "w", "p", 0, 1, "DPR", "USES", "nq", "e", None), (2, 0, "w", "p", 0, 1, "dpr", "USES", "NQ", "later", 0.1), (3, 0, "w", "p", 0, 1, "NQ", "USES", "DPR", "e", 1.0), (4, 0, "w", "p", 0, 1, "ghost", "USES", "NQ", "e", 1.0)]
    aliases = spark.createDataFrame([("dpr", "DPR", "Method"), ("nq", "NQ", "Dataset")], "key string, canonical string, type string")
    edges = graph.typed_edges(spark.createDataFrame(rows, REL), aliases)
    assert [(r.src, r.rel, r.dst, r.evidence, r.confidence) for r in edges.collect()] == [("DPR", "USES", "NQ", "e", 0.8)]
    context = graph.community_context(spark.createDataFrame([("c", "DPR"), ("c", "NQ")], "community string, node string"), edges)
    assert context.first().context == "DPR\nNQ\n\nDPR USES NQ"


@pytest.fixture(scope="module")
def built(spark):
    papers = spark.createDataFrame([("p1", "One", ["Ann", "Bo", None, ""], "abs", ["cs"], 1), ("p1", None, ["Ann"], None, None, 2), ("p2", "Two", None, None, None, 1)], "paper_id string, title string, authors array<string>, abstract string, categories array<string>, ingested_at int")
    entities = spark.createDataFrame([("Dense Passage Retriever", "Method", ["DPR"]), ("Dense Passage Retrieval", "Method", None), ("Natural Questions", "Dataset", ["NQ"]), ("This paper", "Paper", None), ("+", "Method", None), (None, "Task", None)], "name string, type string, aliases array<string>")
    said = [("dpr (large)", "EVALUATES_ON", "NQ", 0.5), ("DPR", "EVALUATES_ON", "natural questions", 0.1), ("this paper", "PROPOSES", "Dense Passage Retrieval", None), ("NQ", "USES", "DPR", 1.0), ("ghost", "USES", "NQ", 1.0), ("DPR", None, "NQ", 1.0)]
    log = spark.createDataFrame([(1, "w1", "p1", 0, 9, [(a, r, b, "e" * 3000, c) for a, r, b, c in said])], "seq bigint, window_id string, paper_id string, char_start int, char_end int, relations array<struct<subject string, predicate string, object string, evidence string, confidence double>>")
    claims = spark.createDataFrame([("p1", "w1", "dpr", "NQ", " F1 ", 0.5, None), ("p1", "w1", "dpr", "NQ", "F1", 0.5, None), ("p1", "w1", "unheard", None, "EM", None, "e"), ("p1", "w1", "dpr", "nq", " ", 0.5, "e"), ("p9", "w1", "dpr", "nq", "EM", 0.5, "e")], "paper_id string, window_id string, method string, dataset string, metric string, value double, evidence string")
    return graph.build_graph(papers, log, entities, claims)


def test_build(built):
    nodes, edges, summary = built
    got = {(r.label, r.key): r for r in nodes.collect()}
    assert {k for k in got if k[0] in ("Method", "Dataset")} == {("Method", "Dense Passage Retriever"), ("Dataset", "Natural Questions")}
    assert got["Method", "Dense Passage Retriever"].aliases == "dense passage retrieval, dense passage retriever, dpr"
    assert got["Paper", "p1"].title == "One" and {("Author", "Ann"), ("Author", "Bo"), ("Metric", "F1"), ("Metric", "EM")} <= set(got) and ("Paper", "This paper") not in got
    rows = sorted((r.rel, r.src, r.dst) for r in edges.collect())
    assert rows == [("AUTHORED_BY", "p1", "Ann"), ("AUTHORED_BY", "p1", "Bo"), ("EVALUATES_ON", "Dense Passage Retriever", "Natural Questions"), ("PROPOSES", "p1", "Dense Passage Retriever"), ("REPORTS", "p1", "EM"), ("REPORTS", "p1", "F1"), ("REPORTS", "p1", "F1")]
    one = edges.filter("rel = 'EVALUATES_ON'").first()
    assert one.confidence == 0.5 and len(one.evidence) == 2000 and one.window_id == "w1"
    assert {(r.method, r.dataset, r.value) for r in edges.filter("rel = 'REPORTS'").collect()} == {("Dense Passage Retriever", "Natural Questions", 0.5), ("unheard", "", 0.0)}
    # Dropped: ghost, the one without a predicate, the reversed USES, the blank metric and the claim of an unknown paper.
    assert summary.first().asDict() == {"canonical_entities": 2, "relations_written": 5, "relations_dropped": 5}
    assert {r.name: r.n for r in graph.counts(nodes, edges).collect()}["-[:REPORTS]->"] == 3


def test_empty_tables_build_an_empty_graph(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    nodes, edges, summary = graph.build_graph(
        empty("paper_id string, title string, authors array<string>, abstract string, categories array<string>, ingested_at int"),
        empty("seq bigint, window_id string, paper_id string, char_start int, char_end int, relations array<struct<subject string, predicate string, object string, evidence string, confidence double>>"),
        empty("name string, type string, aliases array<string>"), empty("paper_id string, window_id string, method string, dataset string, metric string, value double, evidence string"),
    )
    assert nodes.count() == edges.count() == 0 and set(summary.first().asDict().values()) == {0}
    assert Graph(edges, nodes).query("MATCH (a)-[:USES]->(b) RETURN a.name AS a").count() == 0
    assert graph.neighbourhood(edges, "x", 2).count() == 0 and communities.detect_communities(graph.edge_weights(edges, "src", "dst", "confidence")).count() == 0


def test_queries_over_a_built_graph(built):
    nodes, edges, _ = built
    g = Graph(edges, nodes)
    rows = lambda text, **p: [tuple(r) for r in g.query(text, **p).collect()]
    assert rows("MATCH (m:Method) RETURN count(m)") == [(1,)]
    assert rows("MATCH (p:Paper {id: 'p1'})-[:AUTHORED_BY]->(a) RETURN a.name AS a ORDER BY a DESC LIMIT 1") == [("Bo",)]
    assert rows("MATCH (p:Paper)-[:PROPOSES]->(m:Method) WHERE toLower(p.title) CONTAINS 'on' OR m.aliases CONTAINS 'zzz' RETURN p.title AS t, m.name AS m") == [("One", "Dense Passage Retriever")]
    assert rows("MATCH (p:Paper) OPTIONAL MATCH (p)-[:AUTHORED_BY]->(a) WHERE a.name = 'Bo' RETURN p.id AS p, a.name AS a ORDER BY p") == [("p1", "Bo"), ("p2", None)]
    assert rows("MATCH (p:Paper)-[r:REPORTS]->(x:Metric) WHERE r.value >= $least AND NOT x.name = 'none' RETURN x.name AS x, count(*) AS n", least=0.5) == [("F1", 2)]
    assert rows("MATCH (a:Author)-[*1..2]-(b:Method) RETURN DISTINCT a.name AS a, b.name AS b ORDER BY a") == [("Ann", "Dense Passage Retriever"), ("Bo", "Dense Passage Retriever")]
    assert rows("MATCH (p:Paper)-[:AUTHORED_BY]->(a) WITH p, count(DISTINCT a) AS n WHERE n > 1 MATCH (p)-[:PROPOSES]->(m) RETURN m.name AS m, n") == [("Dense Passage Retriever", 2)]
    assert rows("UNWIND ['Ann', 'Zoe'] AS who RETURN who ORDER BY who") == [("Ann",), ("Zoe",)]
    assert rows("MATCH (a:Author) WHERE a.name IN ['Ann', 'OR'] RETURN a.name") == [("Ann",)]
    assert rows("MATCH (p:Paper)-[:PROPOSES]->(m) WHERE m.name STARTS WITH 'Dense' AND p.title = 'One' AND m.aliases ENDS WITH 'dpr' RETURN p.id AS p") == [("p1",)]
    assert rows("MATCH (m:Method) WHERE m.aliases STARTS WITH 'dense' AND m.name <> 'a AND b OR c' RETURN m.name AS m") == [("Dense Passage Retriever",)]
    for bad in ("MATCH (a), (b) RETURN a.name", "MATCH (a) RETURN nope(a)", "MATCH (a:Author RETURN a", "MATCH (a) WHERE a.name = $x RETURN a", "RETURN", "MATCH (a)-[*1..9]->(b) RETURN a"):
        with pytest.raises(UnsafeQuery):
            g.query(bad)
    assert g.has_node("Author", edges.sparkSession.createDataFrame([("Ann",), ("Zoe",)], "k string"), "k").count() == 1


def test_schema_and_members(spark, built):
    said = graph.schema_text().split("\n")
    assert "Paper: key id; title, abstract, published, categories" in said and any(line.startswith("USES: (Paper)->(Method) (Paper)->(Dataset) (Method)->(Dataset); window_id") for line in said)
    assert len(graph.schema_ddl()) == 20 and all(s.startswith("CREATE TABLE IF NOT EXISTS") for s in graph.schema_ddl())
    nodes, edges, _ = built
    members = spark.createDataFrame([("c0", "Dense Passage Retriever"), ("c0", "Ann"), ("c0", "nobody")], "community string, node string")
    assert {(r.src_label, r.src, r.dst) for r in graph.member_edges(members, nodes).collect()} == {("Method", "Dense Passage Retriever", "c0"), ("Author", "Ann", "c0")}
    near = graph.answer_subgraph(edges, ["dense passage", "bo"]).collect()
    assert {(r.name, r.rel) for r in near} == {("dense passage", "EVALUATES_ON"), ("dense passage", "PROPOSES"), ("bo", "AUTHORED_BY")}

import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import answering, backend, evaluation, retrieval
from scriptorium.operators.match import Graph
from scriptorium.sources.indexes import VectorStore


def ranked(spark, keys):
    return spark.createDataFrame([("q", k, i + 1) for i, k in enumerate(keys)], "q string, k string, rank int")


def test_fusion(spark):
    got = retrieval.fuse([("vector", ranked(spark, "abc")), ("bm25", ranked(spark, "dab"))], "q", "k").orderBy("rank").collect()
    assert [r.k for r in got][0] == "a" and len(got) == 4 and got[0].source == "bm25+vector"
    assert retrieval.fuse([("v", ranked(spark, "abc")), ("b", ranked(spark, "").limit(0))], "q", "k", 2).count() == 2
    same = retrieval.fuse([("v", ranked(spark, "ab")), ("b", ranked(spark, "ba"))], "q", "k").collect()
    assert len({r.score for r in same}) == 1 and [r.k for r in sorted(same, key=lambda r: r.rank)] == ["a", "b"]


def test_bm25_finds_terms(spark):
    docs = spark.createDataFrame([(1, "graph index"), (2, "graph of graphs"), (3, "sparse index of terms"), (4, None), (5, "")], "d int, text string")
    asked = spark.createDataFrame([("q", "sparse terms"), ("none", "absent"), ("null", None)], "q string, text string")
    got = retrieval.bm25_search(asked, "q", "text", docs, "d", "text").collect()
    assert [(r.q, r.d) for r in got] == [("q", 3)] and got[0].score > 0
    assert retrieval.bm25_search(asked, "q", "text", docs.limit(0), "d", "text").count() == 0


def test_blocks_and_batches_change_nothing(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    docs = spark.createDataFrame([(i, say(rng.randrange(12)) or None) for i in range(60)] + [(99, "")], "d int, text string")
    asked = spark.createDataFrame([(f"q{i}", say(4)) for i in range(9)], "q string, text string")
    index = retrieval.build_index(docs, "d", "text")
    index.save(str(tmp_path / "index"))
    stored = retrieval.LexicalIndex.load(spark, str(tmp_path / "index"))
    vectors = docs.select("d", retrieval.hashed_embedding(F.col("text")).alias("vector"))
    both = lambda i: ([tuple(r) for r in retrieval.search_index(asked, "q", "text", i, "d", 5).orderBy("q", "rank").collect()],
                      [tuple(r) for r in retrieval.hybrid_search(asked, "q", "text", docs, "d", "text", 5, index=i, vectors=vectors).orderBy("q", "rank").collect()])
    want = both(index)
    assert want == both(stored) and len(want[0]) == 45
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 7)
    assert both(index) == want
    plan = retrieval.search_index(asked, "q", "text", index, "d", 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_vector_store_replaces_papers(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    chunks = lambda rows: spark.createDataFrame(rows, "chunk_id string, paper_id string, text string")
    assert store.count() == 0 and store.add(chunks([("a1", "a", "graph index"), ("a2", "a", "more"), ("b1", "b", "sparse terms"), ("b1", "b", "sparse terms")])) == 3
    assert store.add(chunks([("a3", "a", "graph queries"), ("n", None, None)])) == 2 and store.count() == 3
    asked = spark.createDataFrame([("q", "sparse terms")], "q string, text string")
    assert store.search(asked, "q", "text", 1).first().chunk_id == "b1"
    store.delete_paper("b")
    assert store.count() == 2 and len(store.table.versions()) == 1
    store.reset()
    assert store.count() == 0 and store.search(asked, "q", "text", 1).count() == 0


def test_vector_search(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "v int, e array<float>")
    asked = rows.filter("v = 1").select(F.col("v").alias("q"), "e")
    got = retrieval.vector_search(asked, "q", "e", rows, "v", "e", 5).orderBy("rank").collect()
    assert [(r.v, r.score) for r in got] == [(1, 1.0), (2, pytest.approx(0.707107)), (3, 0.0)]


def test_hybrid_modes(spark):
    docs = spark.createDataFrame([(i, f"text {i} word{i}") for i in range(30)], "d int, text string")
    asked = spark.createDataFrame([("q", "word7")], "q string, text string")
    for mode in ("hybrid", "bm25", "vector"):
        found = [r.d for r in retrieval.hybrid_search(asked, "q", "text", docs, "d", "text", 3, mode).orderBy("rank").collect()]
        assert 7 in found and len(found) <= 3 and (mode != "bm25" or found == [7])  # hashed vectors may collide
    with pytest.raises(ValueError):
        retrieval.hybrid_search(asked, "q", "text", docs, "d", "text", 3, "other")


def test_metrics(spark):
    relevant = spark.createDataFrame([("q", "a"), ("lonely", "z")], "q string, k string")
    got = {r.q: r for r in retrieval.retrieval_metrics(ranked(spark, "xa"), relevant, "q", "k", 2).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].mrr) == (1.0, 0.5, 0.5)
    assert got["q"].ndcg == round(1 / math.log2(3), 4) and got["lonely"].recall == 0


def test_routes(spark):
    said = {
        "How many methods use X?": "graph", "Which dataset is used most?": "graph", "top 5 methods": "graph",
        "What are the main themes?": "global", "Summarise the corpus": "global", "What does DPR do?": "hybrid", "How many themes across the corpus?": "graph",
    }
    rows = spark.createDataFrame([(q,) for q in said], "q string").select("q", answering.route(F.col("q")).alias("m")).collect()
    assert {r.q: r.m for r in rows} == said


LABELLED = {
    "What benchmark datasets are used across this collection of papers?": "global", "How do the retrieval approaches in this corpus relate to each other?": "global",
    "What application domains do these papers cover?": "global", "Give me an overview of the retrieval techniques represented here.": "global",
    "What are the main research themes across these papers?": "global", "How many papers here work on visual question answering?": "graph",
    "Count the distinct evaluation datasets across all of these papers.": "graph", "Which task is addressed by the largest number of methods in this collection?": "graph",
    "Which datasets use both?": "graph", "Why is negative sampling important?": "hybrid", "What is the main theme?": "hybrid",
}


def test_labelled_routes(spark):
    rows = spark.createDataFrame([(q,) for q in LABELLED], "q string").select("q", answering.route(F.col("q")).alias("m")).collect()
    assert {r.q: r.m for r in rows} == LABELLED and {q: answering.choose_mode(q)[0] for q in LABELLED} == LABELLED

    class Model:
        def __init__(self, mode):
            self.mode = mode

        def parse(self, system, user, fields, max_tokens):
            if self.mode is None:
                raise RuntimeError("down")
            return {"mode": self.mode, "reason": "said"}

    assert [answering.choose_mode("Why?", Model(m))[0] for m in ("vector", "sql", None)] == ["vector", "hybrid", "hybrid"]
    assert answering.choose_mode("How many papers use BERT?", Model("vector"))[0] == "graph"


class Scripted:
    """A model that writes the given graph queries in turn, and answers with the first source."""

    def __init__(self, *queries):
        self.queries, self.asked = list(queries), []

    def complete(self, system, user, max_tokens):
        if system.startswith(answering.QUERY_PROMPT):
            self.asked.append(user)
            return self.queries.pop(0)
        return "It is so [1] [9]."

    def parse(self, system, user, fields, max_tokens):
        return {"mode": "vector", "reason": ""}


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([(f"c{i}", "p", f"text {i} word{i}") for i in range(6)] + [("c0", "p", "text 0 word0")], "chunk_id string, paper_id string, text string")
    edges = spark.createDataFrame([("USES", "Method", "MossRank", "Dataset", "Harbor QA", 1.0)], "rel string, src_label string, src string, dst_label string, dst string, confidence double")
    communities = spark.createDataFrame([("c0", "Ranking", "about ranking", 4), ("c1", "", "", 3)], "community_id string, title string, summary string, size int")
    return answering.Corpus(chunks, Graph(edges), communities)


GOOD = "```cypher\nMATCH (m:Method)-[:USES]->(d:Dataset) RETURN m.name AS m, d.name AS d\n```"


def test_dispatch_and_fallbacks(spark, corpus):
    got = answering.ask("How many methods use Harbor QA?", corpus, Scripted(GOOD))
    assert (got.mode, got.fell_back, got.rows) == ("graph", False, [{"m": "MossRank", "d": "Harbor QA"}]) and got.hits[0][0] == "graph-result"
    assert "1. m=MossRank, d=Harbor QA" in got.hits[0][1] and got.cited == ["graph-result"] and got.dropped == [9]
    model = Scripted("MATCH (m) DELETE m", GOOD)
    assert answering.run_graph_query("q", corpus.graph, model)[0] and "rejected" in model.asked[1]
    model = Scripted("MATCH (m) RETURN m.nothing", "CALL x()")
    got = answering.ask("How many are there?", corpus, model)
    assert got.mode == "graph" and got.fell_back and got.query is None and len(model.asked) == 2 and all(h.startswith("c") for h, _ in got.hits)
    got = answering.ask("What are the main themes?", corpus, Scripted())
    assert [h for h, _ in got.hits] == ["community:c0"] and not got.fell_back and "Ranking" in got.hits[0][1]
    bare = answering.Corpus(corpus.chunks)
    assert answering.ask("What are the main themes of word3?", bare, Scripted()).fell_back
    got = answering.ask("word3", corpus, Scripted(GOOD), k=2, mode="hybrid")
    assert [h for h, _ in got.hits][:2] == ["graph-result", "c3"] and got.reason == "forced"
    assert answering.ask("word3", corpus, Scripted(), k=1, mode="vector").hits == [("c3", "text 3 word3")]
    for question, k, mode in (("x", 8, "sql"), ("", 8, None), ("x" * 2001, 8, None), ("x", 0, None), ("x", 51, None)):
        with pytest.raises(ValueError):
            answering.ask(question, corpus, Scripted(), k, mode)
    assert backend.RuleBackend().complete("", "How many methods use Harbor?").startswith("MATCH (a:Method)-[]-(b) WHERE toLower(b.name) CONTAINS 'harbor' RETURN count(DISTINCT a)")
    assert answering.ask("How many methods use Harbor?", corpus, backend.RuleBackend()).rows == [{"n": 1}]


def test_benchmark(spark, corpus, tmp_path):
    gold = spark.createDataFrame([("1", "what says word3", "local", "it", ["p"], None), ("2", "main themes", "global", "all", None, None)], "id string, question string, category string, reference string, relevant_papers array<string>, notes string")
    assert evaluation.load_gold(spark, str(tmp_path / "gold"), gold).count() == 2 == evaluation.load_gold(spark, str(tmp_path / "gold")).count()
    assert evaluation.relevant_chunks(gold, corpus.chunks).count() == 6
    results = spark.createDataFrame(evaluation.run_benchmark(gold, corpus, backend.RuleBackend, ["bm25", "routed"], k=3).collect(), evaluation.RESULT)
    rows = {(r.question_id, r.system): r for r in results.collect()}
    assert len(rows) == 4 and rows["1", "bm25"].recall > 0 and rows["2", "bm25"].recall is None and rows["2", "routed"].mode == "global" and rows["1", "bm25"].correctness == 3.0
    assert evaluation.run_benchmark(gold, corpus, backend.RuleBackend, ["bm25"], results, k=3).count() == 0
    ranked = spark.createDataFrame([("1", "graph-result", 1), ("1", "c0", 2), ("1", "zz", 3)], "id string, chunk_id string, rank int")
    assert evaluation.score_passages(ranked, gold, corpus.chunks, 1).first().precision == 1.0
    assert retrieval.mean_metrics(evaluation.score_passages(ranked, gold, corpus.chunks, 1)).first().n == 1
    assert {(r.category, r.mode, r.n) for r in evaluation.route_histogram(results.filter("system = 'routed'")).collect()} == {("local", "hybrid", 1), ("global", "global", 1)}
    report = open(evaluation.write_report(results, str(tmp_path / "r.md"))).read()
    assert "## Overall" in report and "| bm25 |" in report

    class Odd(backend.RuleBackend):
        def parse(self, system, user, fields, max_tokens=0):
            return {f: 7 for f in fields}

    graded = evaluation.judge_answers(spark.createDataFrame([("q", "r", None, "a")], "question string, reference string, context string, answer string"), Odd).first()
    assert graded.correctness is None and graded.reason is None


def test_citations(spark):
    rows = spark.createDataFrame([(1, "x [2] y [1][2]"), (2, "[1] [7]"), (3, "[0]"), (4, "none")], "k int, a string")
    got = {r.k: (r.cited, r.dropped) for r in answering.citations(rows, "k", "a", F.lit(3)).collect()}
    assert got == {1: ([2, 1], []), 2: ([1], [7]), 3: ([], [0]), 4: ([], [])}


def test_global_search_keeps_few_and_ranks_many(spark):
    schema = "community_id string, title string, summary string, size int"
    few = spark.createDataFrame([(f"c{i}", f"t{i}", "s", 9 - i) for i in range(3)], schema)
    assert [r.chunk_id for r in answering.global_search(few, retrieval.hashed_embedding, "x", 1).orderBy(F.desc("score")).collect()] == ["community:c0", "community:c1", "community:c2"]
    many = spark.createDataFrame([("c0", "dense retrieval", "retrieval of passages", 3), *((f"c{i}", f"other{i}", f"topic{i}", 3) for i in range(1, 7))], schema)
    got = answering.global_search(many, retrieval.hashed_embedding, "dense retrieval passages", 3).orderBy(F.desc("score")).collect()
    assert len(got) == 3 and got[0].chunk_id == "community:c0"


def test_summary_and_winners(spark):
    schema = "question_id string, category string, system string, correctness double, faithfulness double, completeness double, tokens int, latency_s double, error string, run int"
    rows = spark.createDataFrame(
        [("1", "local", "a", 4.0, 4.0, 4.0, 10, 1.0, None, 1), ("2", "local", "a", None, None, None, 10, 1.0, "boom", 1), ("1", "local", "b", 4.0, 3.0, 2.0, 20, 2.0, None, 1)], schema
    )
    summary = evaluation.summarise(evaluation.latest_runs(rows))
    a = summary.filter("system = 'a' and category = 'overall'").first()
    assert (a.n, a.correctness, a.errors) == (2, 4.0, 1)
    assert {r.category: r.winner for r in evaluation.winners(summary).collect()} == {"overall": "a / b", "local": "a / b"}
    assert evaluation.markdown(summary).startswith("| system")
    asked = spark.createDataFrame([("1",), ("2",)], "question_id string")
    systems = spark.createDataFrame([("a",), ("b",)], "system string")
    assert {(r.question_id, r.system) for r in evaluation.pending_runs(asked, systems, rows).collect()} == {("2", "a"), ("2", "b")}

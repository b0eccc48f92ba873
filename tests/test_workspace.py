import time

import pytest

from scriptorium.operators import backend, evaluation
from scriptorium.plans import pipeline
from scriptorium.service import Service
from scriptorium.settings import Settings, get_settings

PAPER = "Introduction\n\n" + "MossRank is a method that ranks passages. It is evaluated on Harbor QA. " * 30 + "\n\nReferences\n\n" + "Some reference. " * 20


def make_extractor():
    """Defined in a function, so that workers get it by value."""
    import json

    class Extractor(backend.RuleBackend):
        """Says what every window of the test states."""

        def complete(self, system, user, max_tokens=1500):
            if not system.startswith("Extract"):
                return super().complete(system, user, max_tokens)
            if "broken" in user:
                raise RuntimeError("no")
            names = [("MossRank", "Method", ["mr"]), ("Harbor QA", "Dataset", []), ("Lantern", "Method", []), ("Tundra", "Dataset", [])]
            said = [("MR", "EVALUATES_ON", "Harbor QA"), ("Lantern", "EVALUATES_ON", "harbor qa"), ("Lantern", "BUILDS_ON", "MossRank"), ("ghost", "USES", "Harbor QA")]
            return json.dumps({
                "entities": [{"name": n, "type": t, "aliases": a, "description": ""} for n, t, a in names],
                "relations": [{"subject": a, "predicate": r, "object": b, "evidence": "e", "confidence": 0.9} for a, r, b in said],
                "results": [{"method": "mr", "dataset": "Harbor QA", "metric": "F1", "value": 0.5, "evidence": "e"}],
            })

    return Extractor


Extractor = make_extractor()


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("work"))
    return pipeline.Workspace(spark, Settings(work=folder, chunk_tokens=120, chunk_overlap=20, window_tokens=400, window_overlap=40))


def documents(spark, rows):
    full = [(i, f"Paper {i}", ["Ann"], "abs", None, ["cs"], t) for i, t in rows]
    return spark.createDataFrame(full, "paper_id string, title string, authors array<string>, abstract string, published date, categories array<string>, full_text string")


def test_stages(spark, work, tmp_path):
    with pytest.raises(FileNotFoundError):
        work.read("chunks")
    assert pipeline.stats(work) == {"papers": 0, "chunks": 0, "windows": 0, "vectors": 0}
    first = pipeline.ingest(work, documents(spark, [("p1", PAPER), ("p1", PAPER), ("p2", "too short"), (None, PAPER)]))
    assert first["papers"] == 1 and first["chunks"] == first["vectors"] > 3
    again = pipeline.ingest(work, documents(spark, [("p1", PAPER), ("p3", PAPER.replace("ranks", "sorts"))]))
    assert again["papers"] == 1 and pipeline.stats(work)["papers"] == 2 and pipeline.stats(work)["vectors"] == first["vectors"] + again["vectors"]
    assert pipeline.ingest(work, documents(spark, [("p1", PAPER)]), force=True)["papers"] == 1 and pipeline.stats(work)["papers"] == 2
    same = pipeline.reindex(work)
    assert same["vectors"] == same["chunks"] == pipeline.stats(work)["chunks"]
    total = pipeline.stats(work)["windows"]
    assert pipeline.extract(work, Extractor, limit=1) == {"windows_total": total, "already_done": 0, "attempted": 1, "succeeded": 1, "failed": 0}
    assert pipeline.extract(work, Extractor)["attempted"] == total - 1 and pipeline.extract(work, Extractor)["attempted"] == 0
    built = pipeline.build(work)
    assert built["canonical_entities"] == 4 and work.read("merges").count() == 0
    assert {(r.rel, r.src, r.dst) for r in work.read("edges").filter("rel in ('EVALUATES_ON', 'BUILDS_ON')").collect()} == {("EVALUATES_ON", "MossRank", "Harbor QA"), ("EVALUATES_ON", "Lantern", "Harbor QA"), ("BUILDS_ON", "Lantern", "MossRank")}
    assert pipeline.find_communities(work) == 1 and work.read("in_community").count() == 3
    gold = spark.createDataFrame([("1", "what is evaluated on Harbor QA", "local", "it", ["p1", "p3"], None)], evaluation.GOLD)
    rows = {(r.system, r.category): r for r in pipeline.evaluate(work, gold, ["hybrid", "routed"], 3, report=str(tmp_path / "report.md")).collect()}
    assert rows["hybrid", "overall"].recall > 0 and rows["routed", "local"].n == 1
    assert pipeline.evaluate(work, gold, ["hybrid"], 3).count() == 4 and work.read("results").count() == 2
    code, said = pipeline.run_pipeline(work, documents(spark, [("p1", PAPER)]), None, ("communities", "evaluate"))
    assert code == 0 and said["ingest"]["papers"] == 0 and said["graph"]["canonical_entities"] == 4
    with pytest.raises(ValueError):
        pipeline.run_pipeline(work, documents(spark, []), None, ("nothing",))


def test_service(spark, work):
    service = Service(work)
    said = service.stats()
    assert said["index"]["papers"] == 2 and said["graph"]["-[:BUILDS_ON]->"] == 1
    got = service.ask("How many methods use Harbor?")
    assert got["mode"] == "graph" and got["rows"] == [{"n": 2}] and set(got["citations"]) <= {"graph-result"}
    assert service.ask("What are the main themes?")["hits"][0]["chunk_id"].startswith("community:")
    rows = service.search("passages of MossRank", 2)
    assert len(rows) == 2 and rows[0]["section"] == "Introduction" and len(rows[0]["text"]) <= 400
    assert service.subgraph("moss", 1)["nodes"] == ["Harbor QA", "Lantern", "MossRank"] and service.communities()[0]["size"] == 3
    with pytest.raises(ValueError):
        service.start_ingest(documents(spark, []), 0)
    job = service.start_ingest(documents(spark, [("p4", PAPER)]), 5)
    for _ in range(300):
        if service.job(job)["status"] in ("done", "failed"):
            break
        time.sleep(0.2)
    assert service.job(job)["status"] == "done" and service.stats()["index"]["papers"] == 3 and service.job("none") is None


def test_settings():
    s = get_settings({"SCRIPTORIUM_TOP_K": "5", "SCRIPTORIUM_WORK": "x", "OTHER": "1"})
    assert s.top_k == 5 and s.work.startswith("/") and s.chunk_tokens == 800
    for bad in ({"SCRIPTORIUM_TOP_K": "0"}, {"SCRIPTORIUM_CHUNK_OVERLAP": "900"}):
        with pytest.raises(ValueError):
            get_settings(bad)


def test_found_papers(spark):
    rows = spark.createDataFrame([("b", " A  title\n", "x  y", 1), ("a", "T", None, 2), ("c", "U", "z", 3), (None, "V", "z", 4)], "paper_id string, title string, abstract string, found int")
    got = pipeline.found_papers(rows, 2, spark.createDataFrame([("a",)], "paper_id string")).collect()
    assert [(r.paper_id, r.title, r.abstract) for r in got] == [("b", "A title", "x y")]


def test_rule_backend_extracts():
    said = backend.RuleBackend()._extract("MossRank is evaluated on Harbor QA. FoldNet builds on MossRank. FoldNet outperforms MossRank. nothing here")
    assert {(e["name"], e["type"]) for e in said["entities"]} == {("MossRank", "Method"), ("Harbor QA", "Dataset"), ("FoldNet", "Method")}
    assert [(r["subject"], r["predicate"], r["object"]) for r in said["relations"]] == [("MossRank", "EVALUATES_ON", "Harbor QA"), ("FoldNet", "BUILDS_ON", "MossRank"), ("FoldNet", "COMPARES_TO", "MossRank")]

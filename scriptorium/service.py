"""What a web or desktop front calls: plain functions over a workspace that take and return JSON-like values."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import answering, communities, graph
from scriptorium.plans import pipeline

PREVIEW = 400


class Service:
    """Requests over one workspace; the corpus is opened once and again after an ingest."""

    def __init__(self, work: pipeline.Workspace):
        self.work, self.jobs, self._corpus, self._lock = work, {}, None, threading.Lock()

    def corpus(self) -> answering.Corpus:
        with self._lock:
            if self._corpus is None:
                self._corpus = self.work.corpus()
            return self._corpus

    def reset(self) -> None:
        """Forget the opened corpus."""
        with self._lock:
            self._corpus = None

    def stats(self) -> dict[str, object]:
        """Sizes of the index and of the graph; a graph that is not there is an empty one."""
        nodes, edges = self.work.table("nodes").read(), self.work.table("edges").read()
        counts = {} if edges is None else {r.name: r.n for r in graph.counts(nodes, edges).collect()}
        return {"index": pipeline.stats(self.work), "graph": counts}

    def ask(self, question: str, k: int = 8, mode: str | None = None) -> dict[str, object]:
        """An answered question with its sources."""
        got = answering.ask(question, self.corpus(), self.work.backend("answer"), k, mode)
        hits = [{"chunk_id": name, "text": text[:PREVIEW]} for name, text in got.hits]
        return {"answer": got.text, "mode": got.mode, "reason": got.reason, "query": got.query, "rows": got.rows, "citations": got.cited, "dropped": got.dropped, "fell_back": got.fell_back, "hits": hits}

    def search(self, q: str, k: int = 8, mode: str = "hybrid") -> list[dict[str, object]]:
        """Passages with rounded scores and a preview."""
        answering.check_request(q, k, None)
        corpus = self.corpus()
        asked = self.work.spark.createDataFrame([("q", q)], "q string, question string")
        found = answering.hybrid_search(asked, "q", "question", corpus.chunks, "chunk_id", "text", k, mode, embed=corpus.embed, index=corpus.index, vectors=corpus.vectors)
        rows = found.join(corpus.chunks.dropDuplicates(["chunk_id"]), "chunk_id").orderBy("rank")
        shown = rows.select("chunk_id", "paper_id", "section", "source", F.round("score", 4).alias("score"), F.substring("text", 1, PREVIEW).alias("text"))
        return [r.asDict() for r in shown.collect()]

    def subgraph(self, entity: str, depth: int = 1, limit: int = 60) -> dict[str, object]:
        """Edges within one or two hops of an entity, and their nodes in order."""
        rows = graph.neighbourhood(self.work.read("edges"), entity, depth, limit).collect()
        return {"nodes": sorted({n for r in rows for n in (r.source, r.target)}), "edges": [r.asDict() for r in rows]}

    def communities(self) -> list[dict[str, object]]:
        """Stored communities, the largest first."""
        rows = self.work.table("communities").read()
        return [] if rows is None else [r.asDict() for r in communities.load_communities(rows).collect()]

    def start_ingest(self, documents: DataFrame, limit: int = 20) -> str:
        """Ingest in the background; the id of the job."""
        if not 1 <= limit <= 100:
            raise ValueError("limit is 1 to 100")
        job = uuid.uuid4().hex[:12]
        self.jobs[job] = {"status": "queued"}

        def run() -> None:
            self.jobs[job] = {"status": "running"}
            try:
                self.jobs[job] = {"status": "done", "result": pipeline.ingest(self.work, documents.orderBy("paper_id").limit(limit))}
            except Exception as error:  # noqa: BLE001 - the job tells
                self.jobs[job] = {"status": "failed", "error": str(error)[:300]}
            self.reset()

        thread = threading.Thread(target=run, daemon=True)
        self.jobs[job]["thread"] = thread
        thread.start()
        return job

    def job(self, name: str) -> dict[str, object] | None:
        """The state of a job: queued, running, done or failed."""
        found = self.jobs.get(name)
        return None if found is None else {k: v for k, v in found.items() if k != "thread"}

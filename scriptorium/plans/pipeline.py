"""The write path: papers to chunks, indexes, records, graph, communities and a benchmark.

Each stage reads stored tables and replaces its own, so it can be run again or left out; what is done is left out by an
anti-join. Stages pass tables, never rows over the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import chunking, communities, evaluation, extraction, graph, resolution, retrieval
from scriptorium.operators.answering import Corpus
from scriptorium.operators.backend import Backend, Meter, MeteredBackend, TokenBucket, make_backend
from scriptorium.operators.match import Graph
from scriptorium.operators.text import LEAST_TEXT, clean_text, collapse_blanks
from scriptorium.settings import Settings, get_settings
from scriptorium.sources.indexes import StoredTable, VectorStore
from scriptorium.sources.records import read_log

STAGES = ["ingest", "extract", "graph", "communities", "evaluate"]
PAPERS = ["paper_id", "title", "authors", "abstract", "published", "categories"]
LOGGED = f"run bigint, window_id string, paper_id string, char_start int, char_end int, status string, error string, extraction struct<{extraction.EXTRACTED}>"


def found_papers(papers: DataFrame, limit: int = 20, known: DataFrame | None = None) -> DataFrame:
    """Papers of a search (paper_id, title, abstract, ...) as they are ingested: blanks collapsed, the first `limit` in order,
    without those whose files are `known` (paper_id) already (A1)."""
    rows = papers.withColumn("title", collapse_blanks(F.col("title"))).withColumn("abstract", collapse_blanks(F.col("abstract")))
    rows = rows.filter("paper_id is not null").dropDuplicates(["paper_id"])
    order = "found" if "found" in rows.columns else "paper_id"
    rows = rows.orderBy(order).limit(limit)
    return rows if known is None else rows.join(known.select("paper_id"), "paper_id", "left_anti")


@dataclass
class Workspace:
    """The stored tables of a pipeline under one folder."""

    spark: SparkSession
    settings: Settings

    def table(self, name: str) -> StoredTable:
        return StoredTable(self.spark, f"{self.settings.work}/{name}")

    def read(self, name: str) -> DataFrame:
        """A stored table; an error names the stage that is missing."""
        rows = self.table(name).read()
        if rows is None:
            raise FileNotFoundError(f"no table {name!r} yet; run its stage first")
        return rows

    def vectors(self) -> VectorStore:
        return VectorStore(self.spark, f"{self.settings.work}/vectors")

    @property
    def log(self) -> str:
        return f"{self.settings.work}/extractions"

    def has_log(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.log)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def records(self) -> DataFrame:
        """The extraction log; empty before the first run."""
        if not self.has_log():
            return self.spark.createDataFrame([], LOGGED)
        return read_log(self.spark, self.log, LOGGED)

    def accepted(self) -> DataFrame:
        """The last accepted record of each window, numbered by its run."""
        return extraction.done_windows(self.records().withColumnRenamed("run", "seq"))

    def corpus(self) -> Corpus:
        """What questions are asked of, as far as the stages have come."""
        nodes, edges, found = self.table("nodes").read(), self.table("edges").read(), self.table("communities").read()
        index = retrieval.LexicalIndex.load(self.spark, f"{self.settings.work}/lexical")
        vectors = self.vectors().table.read().select("chunk_id", "vector")
        return Corpus(self.read("chunks"), None if edges is None else Graph(edges, nodes), found, index, vectors)

    def backend(self, stage: str, meter: Meter | None = None) -> Backend:
        """The configured model behind its budget and rate."""
        s = self.settings
        bucket = TokenBucket(s.calls_a_second) if s.calls_a_second else None
        return MeteredBackend(make_backend(s.backend), meter or Meter(limit=s.budget or None), stage, s.backend, bucket)


def backend_maker(work: Workspace) -> Callable[[], Backend]:
    """What makes the configured model in a task; it carries the name alone."""
    name = work.settings.backend
    return lambda: make_backend(name)


def ingest(work: Workspace, documents: DataFrame, force: bool = False) -> dict[str, int]:
    """Store new papers (PAPERS and full_text) with their chunks and windows, and index them (A5, C14).

    A paper that is stored already is left out unless `force` replaces it; papers of fewer than LEAST_TEXT characters of
    cleaned text are dropped. The vectors of new papers are added, the lexical index is built over all papers.
    """
    s, papers = work.settings, work.table("papers")
    before = papers.read()
    rows = documents.filter("paper_id is not null").dropDuplicates(["paper_id"])
    if before is not None and not force:
        rows = rows.join(before.select("paper_id"), "paper_id", "left_anti")
    rows = rows.withColumn("full_text", clean_text(F.col("full_text"))).filter(F.length("full_text") >= LEAST_TEXT)
    fresh = StoredTable(work.spark, f"{s.work}/fresh")
    fresh.write(rows.select(*PAPERS, "full_text"))
    rows = fresh.read()
    chunks = chunking.build_chunks(rows, "paper_id", "full_text", target=s.chunk_tokens, overlap=s.chunk_overlap)
    windows = chunking.build_windows(rows, "paper_id", "full_text", target=s.window_tokens, overlap=s.window_overlap)
    for name, new in (("papers", rows), ("chunks", chunks), ("windows", windows)):
        table = work.table(name)
        old = table.read()
        table.write(new if old is None else graph.replace_by_key(old.join(rows.select("paper_id"), "paper_id", "left_anti"), new, "paper_id").select(*new.columns))
    made = work.read("chunks").join(rows.select("paper_id"), "paper_id", "left_semi")
    vectors = work.vectors().add(made)
    retrieval.build_index(work.read("chunks"), "chunk_id", "text").save(f"{s.work}/lexical")
    return {"papers": rows.count(), "chunks": made.count(), "vectors": vectors, "dropped": documents.select("paper_id").distinct().count() - rows.count()}


def reindex(work: Workspace) -> dict[str, int]:
    """Build both indexes anew from the stored chunks."""
    store, chunks = work.vectors(), work.read("chunks")
    store.reset()
    store.add(chunks)
    retrieval.build_index(chunks, "chunk_id", "text").save(f"{work.settings.work}/lexical")
    return {"papers": work.read("papers").count(), "chunks": chunks.select("chunk_id").distinct().count(), "vectors": store.count()}


def stats(work: Workspace) -> dict[str, int]:
    """Sizes of the stored corpus, zero before a stage has run."""
    size = lambda rows: 0 if rows is None else rows.count()
    return {n: size(work.table(n).read()) for n in ("papers", "chunks", "windows")} | {"vectors": work.vectors().count()}


def extract(work: Workspace, backend: Callable[[], Backend] | None = None, limit: int | None = None, force: bool = False) -> dict[str, int]:
    """Append a record for each pending window."""
    windows, done = work.read("windows"), work.accepted().select("window_id")
    if force:
        done = done.limit(0)
    run = (work.records().agg(F.max("run")).first()[0] or 0) + 1
    make = backend or backend_maker(work)
    records = extraction.run_extraction(windows, make, titles=work.read("papers"), done=done, limit=limit)
    fresh = StoredTable(work.spark, f"{work.settings.work}/records")
    fresh.write(records)
    records = fresh.read()
    summary = extraction.run_summary(windows, done, records).first().asDict()
    columns = ["window_id", "paper_id", "char_start", "char_end", "status", "error", "extraction"]
    records.select(F.lit(run).cast("bigint").alias("run"), *columns).write.mode("append").json(work.log)
    return summary


def build(work: Workspace) -> dict[str, int]:
    """Build the graph anew from the accepted records; also the audit of merged names."""
    log = work.accepted()
    entities = log.select(F.explode("extraction.entities").alias("e")).select("e.name", "e.type", "e.aliases")
    claims = log.select("paper_id", "window_id", F.explode("extraction.results").alias("r")).select("paper_id", "window_id", "r.*")
    rows = log.select("seq", "window_id", "paper_id", "char_start", "char_end", F.col("extraction.relations").alias("relations"))
    papers = work.read("papers").withColumn("ingested_at", F.lit(0))
    nodes, edges, summary = graph.build_graph(papers, rows, entities, claims)
    work.table("nodes").write(nodes)
    work.table("edges").write(edges)
    work.table("merges").write(resolution.merge_audit(entities))
    return summary.first().asDict()


def find_communities(work: Workspace, backend: Callable[[], Backend] | None = None, resolution_: float = 1.0) -> int:
    """Find, summarise and store the communities with their member edges; how many there are (H1-H6)."""
    edges = work.read("edges")
    thematic = edges.filter(F.col("rel").isin(graph.THEMATIC) & (F.col("src_label") != "Paper") & (F.col("dst_label") != "Paper"))
    members = communities.detect_communities(graph.edge_weights(thematic, "src", "dst", "confidence"), resolution_)
    work.table("members").write(members)
    members = work.read("members")
    contexts = graph.community_context(members, edges).join(members.select("community", "size").distinct(), "community")
    summaries = communities.summarise_communities(contexts, backend or backend_maker(work))
    work.table("communities").write(communities.community_nodes(members, summaries))
    work.table("in_community").write(graph.member_edges(members, work.read("nodes")))
    return work.read("communities").count()


def evaluate(work: Workspace, gold: DataFrame, systems: list[str], k: int, judge: bool = True, report: str | None = None, report_only: bool = False) -> DataFrame:
    """Run what is pending of a benchmark, store its results and return their summary."""
    table = work.table("results")
    before = table.read()
    if not report_only:
        run = 1 if before is None else (before.agg(F.max("run")).first()[0] or 0) + 1
        fresh = evaluation.run_benchmark(gold, work.corpus(), backend_maker(work), systems, before, k, judge, run)
        table.write(fresh if before is None else before.unionByName(fresh))
    results = work.read("results")
    if report:
        evaluation.write_report(results, report)
    return evaluation.summarise(evaluation.latest_runs(results))


def run_pipeline(work: Workspace, documents: DataFrame, gold: DataFrame | None = None, skip: tuple[str, ...] = (), judge: bool = True) -> tuple[int, dict[str, object]]:
    """(exit code, what each stage said): all stages but the skipped ones; stops where a stage has nothing to go on with."""
    said: dict[str, object] = {}
    if unknown := set(skip) - set(STAGES):
        raise ValueError(f"no stages: {', '.join(sorted(unknown))}")
    if "ingest" not in skip:
        said["ingest"] = ingest(work, documents)
        if not stats(work)["papers"]:
            return 1, said
    if "extract" not in skip:
        said["extract"] = extract(work)
        if said["extract"]["attempted"] and not said["extract"]["succeeded"]:
            return 1, said
    if "graph" not in skip:
        said["graph"] = build(work)
        if not said["graph"]["canonical_entities"]:
            return 1, said
    if "communities" not in skip:
        said["communities"] = find_communities(work)
    if "evaluate" not in skip and gold is not None:
        said["evaluate"] = evaluate(work, gold, evaluation.SYSTEMS, work.settings.top_k, judge).count()
    return 0, said


def open_workspace(spark: SparkSession, work: str | None = None) -> Workspace:
    """The workspace of the settings, or of another folder."""
    settings = get_settings()
    return Workspace(spark, settings if work is None else Settings(**{**settings.__dict__, "work": work}))

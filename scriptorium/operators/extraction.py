"""Extraction log, salvage and validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.operators.backend import Backend

#: Most entities, relations and results of a window.
MOST = {"entities": 60, "relations": 40, "results": 12}
FAILED = "failed"


def done_windows(log: DataFrame) -> DataFrame:
    """The last accepted record of each window; a success wins over any failure, records without a window are ignored."""
    ok = log.filter("status = 'ok' and window_id is not null")
    order = Window.partitionBy("window_id").orderBy(F.desc("seq"))
    return ok.distinct().withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def salvage(raw: Column, schema: str, required: list[str]) -> Column:
    """A struct from text that holds JSON: as it is, in any fenced block, or between the outermost braces; else null (E5).

    The first of them that parses and has the required fields counts.
    """

    def parsed(text: Column) -> Column:
        value = F.from_json(text, schema)
        whole = value.isNotNull()
        for name in required:
            whole = whole & value[name].isNotNull()
        return F.when(whole, value)

    fences = F.regexp_extract_all(raw, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    fenced = F.get(F.filter(F.transform(fences, parsed), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(parsed(raw), fenced, parsed(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def is_valid(extraction: str = "extraction") -> Column:
    """Lengths within their limits (longer ones fail, they are not cut) and confidences within 0 and 1."""
    sizes = [F.coalesce(F.size(f"{extraction}.{k}"), F.lit(0)) <= n for k, n in MOST.items()]
    sure = F.forall(F.coalesce(f"{extraction}.relations", F.array()), lambda r: F.coalesce(r["confidence"].between(0, 1), F.lit(True)))
    whole = sure
    for s in sizes:
        whole = whole & s
    return whole


def prompt(title: Column, sections: Column, text: Column) -> Column:
    """The user prompt of a window."""
    named = F.when(F.size(sections) > 0, F.array_join(sections, ", ")).otherwise("unknown")
    return F.concat(F.lit("Paper: "), title, F.lit("\nSections: "), named, F.lit("\n\n```\n"), text, F.lit("\n```"))


#: Fixed value: tokens of an extraction's answer. The system prompt is the same for every window, so providers may cache it.
EXTRACTION_TOKENS, CACHE_KEY = 32_000, "scriptorium-extraction-1"
SYSTEM = (
    "Extract what the excerpt states: entities (name, type, aliases, description), relations (subject, predicate, object, evidence,"
    " confidence) and results (method, dataset, metric, value, evidence). Types: Author, Institution, Task, Method, Dataset, Metric, Paper."
    " Predicates: AUTHORED_BY, AFFILIATED_WITH, ADDRESSES, PROPOSES, USES, EVALUATES_ON, REPORTS, BUILDS_ON, COMPARES_TO."
    " Names as written; evidence quoted from the excerpt; nothing that it does not state. Answer as JSON."
)
EXTRACTED = (
    "entities array<struct<name:string,type:string,aliases:array<string>,description:string>>,"
    "relations array<struct<subject:string,predicate:string,object:string,evidence:string,confidence:double>>,"
    "results array<struct<method:string,dataset:string,metric:string,value:double,evidence:string>>"
)


def run_extraction(windows: DataFrame, make_backend: Callable[[], Backend], schema: str = EXTRACTED, titles: DataFrame | None = None, done: DataFrame | None = None, limit: int | None = None, checked: bool = True) -> DataFrame:
    """One ok or failed record for each window that `done` (window_id) does not hold; a failure never stops the run.

    `titles` has paper_id and title. `limit` takes the first pending windows in order. The backend is made once a task. An
    answer without the required fields, over the list limits or with a confidence out of range is a failed record;
    `checked` is off for schemas without those lists.
    """
    todo = windows if done is None else windows.join(done.select("window_id"), "window_id", "left_anti")
    if limit is not None:
        todo = todo.orderBy("window_id").limit(limit)
    title = F.lit("")
    if titles is not None:
        todo = todo.join(titles.filter("title is not null").groupBy("paper_id").agg(F.max("title").alias("__title")), "paper_id", "left")
        title = F.coalesce("__title", "paper_id", F.lit(""))
    kind = windows.schema["window_id"].dataType.simpleString()
    carried = [c for c in ("paper_id", "char_start", "char_end") if c in windows.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for frame in frames:
            out = []
            for window_id, text in zip(frame["window_id"], frame["prompt"]):
                try:
                    out.append((window_id, backend.complete(SYSTEM, text, EXTRACTION_TOKENS), None))
                except Exception as error:  # noqa: BLE001 - the record keeps it
                    out.append((window_id, None, f"{type(error).__name__}: {str(error)[:300]}"))
            yield pd.concat([pd.DataFrame(out, columns=["window_id", "raw", "error"]), frame[carried].reset_index(drop=True)], axis=1)

    said = todo.select("window_id", *carried, prompt(title, F.col("sections"), F.col("text")).alias("prompt"))
    kinds = ", ".join([f"window_id {kind}", "raw string", "error string", *[f"{c} {windows.schema[c].dataType.simpleString()}" for c in carried]])
    answers = said.mapInPandas(run, kinds).withColumn("extraction", salvage(F.col("raw"), schema, ["entities"]))
    fine = F.col("extraction").isNotNull() & (is_valid() if checked else F.lit(True))
    error = F.when(~fine, F.coalesce("error", F.when(F.col("extraction").isNull(), "no valid answer").otherwise("answer over its limits")))
    return answers.select("window_id", *carried, F.when(fine, "ok").otherwise(FAILED).alias("status"), error.alias("error"), F.when(fine, F.col("extraction")).alias("extraction"), "raw")


def run_summary(windows: DataFrame, done: DataFrame, records: DataFrame) -> DataFrame:
    """(windows_total, already_done, attempted, succeeded, failed) of a run (E3); what a limit cut off is not counted as done."""
    total = windows.select("window_id").distinct()
    one = lambda df, *cols: df.agg(*cols)
    n = F.count(F.lit(1))
    return (
        one(total, n.alias("windows_total"))
        .crossJoin(one(total.join(done.select("window_id"), "window_id", "left_semi"), n.alias("already_done")))
        .crossJoin(one(records, n.alias("attempted"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed")))
    )

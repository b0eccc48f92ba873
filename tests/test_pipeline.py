import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import backend, extraction
from scriptorium.operators.answering import NO_HIT, answer
from scriptorium.operators.units import convert_values, metric_spellings, read_metrics
from scriptorium.sources.records import append_log, pending, read_log
from scriptorium.streaming.records import follow_log, read_followed


def test_log_reading_skips_bad_lines(spark, tmp_path):
    good = {"seq": 1, "window_id": "w1", "status": "ok"}
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good)[:20] + "\n" + json.dumps(good | {"seq": 2, "status": "failed"}) + "\n")
    log = read_log(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 2 and [r.window_id for r in extraction.done_windows(log).collect()] == ["w1"]
    append_log(log, str(tmp_path / "out"))
    append_log(log, str(tmp_path / "out"))
    assert read_log(spark, str(tmp_path / "out")).count() == 4


def test_done_and_pending(spark):
    log = spark.createDataFrame([(1, "w1", "failed"), (2, "w1", "ok"), (3, "w2", "ok"), (4, "w2", "failed"), (5, None, "ok"), (6, "w2", "ok")], "seq int, window_id string, status string")
    done = extraction.done_windows(log)
    assert {(r.window_id, r.seq) for r in done.collect()} == {("w1", 2), ("w2", 6)}
    assert [r.window_id for r in pending(spark.createDataFrame([("w1",), ("w9",)], "window_id string"), done, "window_id").collect()] == ["w9"]


def test_salvage(spark):
    said = ['{"entities": [1]}', 'text ```json\n{"entities": [2]}\n``` more', 'so: {"entities": [3]} end', "", "none", '{"other": 1}', None]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, raw string").select("i", extraction.salvage(F.col("raw"), "entities array<int>", ["entities"]).alias("e")).orderBy("i").collect()
    assert [r.e and r.e.entities for r in rows] == [[1], [2], [3], None, None, None, None]


def test_run_keeps_failures(spark):
    class Model:
        def complete(self, system, user, max_tokens):
            if "bad" in user:
                raise RuntimeError("no")
            if "long" in user:
                return json.dumps({"entities": [{"name": str(i)} for i in range(61)]})
            if "sure" in user:
                return json.dumps({"entities": [], "relations": [{"subject": "a", "confidence": 1.5}]})
            return "nothing" if "empty" in user else 'so ```x``` and ```json\n{"entities": [{"name": "x"}]}\n```'

    rows = [("w1", "p", "good", ["A"]), ("w2", "p", "bad", None), ("w3", "p", "long", None), ("w4", "q", "sure", None), ("w5", "q", "empty", None), ("w6", "q", "good", None)]
    windows = spark.createDataFrame(rows, "window_id string, paper_id string, text string, sections array<string>")
    titles, done = spark.createDataFrame([("p", "A title"), ("p", None)], "paper_id string, title string"), spark.createDataFrame([("w6",)], "window_id string")
    records = extraction.run_extraction(windows, Model, titles=titles, done=done).cache()
    got = {r.window_id: r for r in records.collect()}
    assert set(got) == {"w1", "w2", "w3", "w4", "w5"} and got["w1"].extraction.entities[0].name == "x" and got["w1"].paper_id == "p"
    assert [got[f"w{i}"].status for i in range(1, 6)] == ["ok"] + ["failed"] * 4 and "no" in got["w2"].error and got["w3"].error == "answer over its limits"
    assert extraction.run_summary(windows, done, records).first().asDict() == {"windows_total": 6, "already_done": 1, "attempted": 5, "succeeded": 1, "failed": 4}
    assert extraction.run_extraction(windows, Model, limit=2).count() == 2


def test_metered_calls(tmp_path):
    class Busy(Exception):
        status = 503

    class Model:
        calls, usage, truncated = 0, backend.Usage(1_000_000, 0), False

        def complete(self, system, user, max_tokens):
            self.calls += 1
            if self.calls == 1:
                raise Busy
            return "fine"

    slept = []
    meter = backend.Meter({"m": (1.0, 5.0)}, limit=2.5)
    model = backend.MeteredBackend(Model(), meter, "answer", "m", sleep=slept.append)
    assert model.complete("s", "u") == "fine" and len(slept) == 1 and meter.cost() == 1.0
    with meter.scoped("run") as inner:
        assert inner.limit == 1.5
        model.meter = inner
        model.complete("s", "u")
        model.complete("s", "u")
        with pytest.raises(backend.BudgetExceeded):
            model.complete("s", "u")
    model.meter = meter
    assert meter.totals() == {"answer": {"calls": 3, "tokens": 3_000_000, "cost": 3.0}} and [r[0] for r in meter.rows] == ["", "run", "run"]
    with pytest.raises(backend.BudgetExceeded):
        model.complete("s", "u")
    meter.write(str(tmp_path / "usage.json"))
    assert json.loads((tmp_path / "usage.json").read_text())["cost"] == 3.0
    model.inner.truncated, meter.limit = True, None
    with pytest.raises(backend.Truncated):
        model.complete("s", "u")
    ticks = iter(range(100))
    assert backend.probe(backend.RuleBackend(), 4, lambda: next(ticks))["median_s"] == 1
    assert backend.parse_json('x {"a": 1} y', ["a"]) == {"a": 1} and backend.parse_json('```json\n{"a": 2}\n```', ["a"]) == {"a": 2}
    with pytest.raises(ValueError):
        backend.parse_json("none", ["a"])


def test_bucket_retry_and_cost(spark):
    now, slept = [0.0], []
    bucket = backend.TokenBucket(2.0, 1, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert [round(bucket.take(), 3) for _ in range(3)] == [0.0, 0.5, 0.5]

    class Busy(Exception):
        status = 429

    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return "ok"

    assert backend.with_retry(flaky, sleep=slept.append, draw=lambda a, b: b) == "ok" and slept[-2:] == [1.0, 2.0]
    with pytest.raises(ValueError):
        backend.with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=slept.append)
    usage = spark.createDataFrame([("s", "m", 10**6, 10**6, 0, 0), ("s", "?", 5, 5, 0, 0), ("c", "m", 0, 0, 10**6, 0)], "stage string, model string, input bigint, output bigint, cache_read bigint, cache_write bigint")
    got = {r.stage: r.cost for r in backend.usage_cost(usage, spark.createDataFrame([("m", 1.0, 5.0)], "model string, input_price double, output_price double")).collect()}
    assert got == {"s": 6.0, "c": 0.1}
    assert sum((backend.Usage(1, 2), backend.Usage(3, 4)), backend.Usage()) == backend.Usage(4, 6)
    with pytest.raises(ValueError):
        backend.make_backend("none")


def test_answer_cites_sources():
    assert answer("q", [], backend.RuleBackend()) == (NO_HIT, [], [])
    text, cited, dropped = answer("what does DPR use", [("a", "Nothing here."), ("b", "DPR does use two encoders.")], backend.RuleBackend())
    assert cited[0] == "b" and not dropped and "[2]" in text


def test_stream_follows_the_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda seq, w, s: json.dumps({"seq": seq, "window_id": w, "status": s}) + "\n"
    (folder / "1.json").write_text(line(1, "w1", "ok") + line(2, "w2", "failed"))
    follow_log(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    (folder / "2.json").write_text(line(3, "w2", "ok") + line(4, "w1", "ok"))
    follow_log(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.window_id, r.seq) for r in read_followed(spark, str(tmp_path / "out")).collect()} == {("w1", 4), ("w2", 3)}


def test_units(spark):
    terms = [("metric", "Accuracy", "score"), ("metric", "Query Latency", "duration"), ("metric", "Peak Memory", "memory"), ("metric", "Throughput", "rate"), ("metric", "Parameter Count", "count"), ("metric", "Training Time", "duration"), ("metric", "Exact Match", "score"), ("metric", "Recall@20", "score"), ("metric", "F1", "score"), ("metric", "Macro F1", "score"), ("dataset", "Harbor QA", None)]
    cases = {
        1: ("Accuracy", 0.5, None, 5000), 2: ("acc", 50.0, "", 5000), 3: ("Accuracy", 0.3, "reaches 0.3% Accuracy", 30), 4: ("acc", 345.0, "was 345‰", 3450),
        5: ("Query Latency (ms)", 2.0, "took 9 s", 2000), 6: ("qry latency", 1423.0, "needs 1,423 usec of it", 1423), 7: ("Query Latency", 3.0, "was 3 on a 48 GB card", None),
        8: ("Peak Memory", 2.0, "2 GiB", 2147483648), 9: ("Peak Memory, MB", 1.5, None, 1500000), 10: ("Throughput in kQPS", 2.0, None, 7200000), 11: ("thruput", 2.0, "2 q/min", 120),
        12: ("Parameter Count - K", 3.0, None, 3000), 13: ("params", 1.5, "1.5 billion parameters", 1500000000), 14: ("Accuracy", -1.0, None, None), 15: ("Accuracy", float("nan"), None, None),
        16: ("Accuracy", None, "50%", None), 17: ("toxicity", 1.0, "1%", None), 18: ("F1 (macro)", 0.7, None, 7000), 19: ("F1 [pct]", 0.7, None, 70), 20: (None, 1.0, "1%", None), 21: ("Accuracy", 1.0, None, 10000),
        24: ("Exat Match", 0.5, None, 5000), 25: ("acuracy", 0.5, None, 5000), 26: ("Traning Time (ms)", 2.0, None, 2000), 27: ("Querry Latency (ms)", 2.0, None, 2000), 28: ("Peek Memory, MB", 1.0, None, 1000000),
        29: ("paramter cuont", 2.0, "2 million parameters", 2000000), 30: ("Recal@20", 0.5, None, 5000), 31: ("Recall@50", 0.5, None, None), 32: ("", 1.0, "1%", None), 33: ("thrghput", 2.0, "2 q/min", 120),
        22: ("Peak Memory", 48.0, "came to 48 over 3 runs", None), 23: ("F1", 0.0, None, 0),
    }
    rows = [(k, *v[:3], "x") for k, v in cases.items()]
    claims = spark.createDataFrame(rows + rows[:3], "claim_id int, metric string, value double, evidence string, units string")
    got = {r.claim_id: r.target_value for r in convert_values(claims, spark.createDataFrame(terms, "field string, canonical string, quantity string")).collect()}
    assert got == {k: v[3] for k, v in cases.items() if v[3] is not None}
    assert convert_values(claims.limit(0), spark.createDataFrame(terms, "field string, canonical string, quantity string")).count() == 0


def test_metrics_are_read_with_unseen_typos(spark):
    rng = random.Random(5)
    names = {"Query Latency": "duration", "Peak Memory": "memory", "Throughput": "rate", "Parameter Count": "count", "Citation Precision": "score", "Energy Use": "energy"}
    typed = {}
    for name in names:
        for _ in range(60):
            i = rng.randrange(1, len(name) - 1)
            typed[rng.choice([name[:i] + name[i + 1 :], name[: i - 1] + name[i] + name[i - 1] + name[i + 1 :], name[:i] + rng.choice("abcdefgh") + name[i:]])] = name
    spellings = metric_spellings(spark.createDataFrame([("metric", n, q) for n, q in names.items()], "field string, canonical string, quantity string"))
    got = {r.metric: r.quantity for r in read_metrics(spark.createDataFrame([(t,) for t in typed], "metric string"), spellings).collect()}
    assert sum(got.get(t) == names[n] for t, n in typed.items()) / len(typed) >= 0.98

"""Model runtime: backends, throttling, retries, metering and budgets (K1-K9)."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from statistics import median
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What cache writes and reads cost against input tokens.
CACHE_WRITE, CACHE_READ = 1.25, 0.10
ATTEMPTS, BASE_S, CAP_S = 6, 1.0, 60.0
#: Labels and the words that name them in a question.
LABEL_WORDS = {"paper": "Paper", "author": "Author", "institution": "Institution", "task": "Task", "method": "Method", "model": "Method", "dataset": "Dataset", "benchmark": "Dataset", "metric": "Metric"}
_STOP = set("a about all an and any are as at by did do does for from has have how in is it its many most number of on one or over than that the there these they this to use used uses using was were what when which who whose why with".split())


class Backend(Protocol):
    """A model: text in, text or checked fields out. It can be pickled, or is made anew in each task."""

    def complete(self, system: str, user: str, max_tokens: int) -> str: ...

    def parse(self, system: str, user: str, fields: list[str], max_tokens: int) -> dict[str, object]: ...


class Truncated(RuntimeError):
    """The answer was cut at its token limit."""


class BudgetExceeded(RuntimeError):
    """The next call would go over the budget."""


def parse_json(text: str, fields: list[str]) -> dict[str, object]:
    """The object in an answer that has all `fields`: the text, a fenced block, or what lies between the outermost braces."""
    fenced = [part.removeprefix("json") for part in text.split("```")[1::2]]
    braces = [text[text.find("{") : text.rfind("}") + 1]] if "{" in text else []
    for candidate in (text, *fenced, *braces):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, dict) and all(f in found for f in fields):
            return found
    raise ValueError("no JSON object with " + ", ".join(fields))


class RuleBackend:
    """Deterministic offline model.

    Extracts names in capitals and what sentences say of them. Answers with the source sentences that share most words with the question; a question alone becomes a graph query
    over the labels and the name that it mentions; fields come from the first words and sentences of the text.
    """

    def complete(self, system: str, user: str, max_tokens: int = 1500) -> str:
        if system.startswith("Extract"):
            return json.dumps(self._extract(user.split("```")[1] if user.count("```") >= 2 else user))
        question, blank, sources = user.partition("\n\n")
        if not blank or not re.search(r"^\[1\] ", sources):
            return self._graph_query(question)
        asked = set(re.findall("[a-z0-9]+", question.lower()))
        scored = []
        for number, said in re.findall(r"\[(\d+)\] (.*?)(?=\n\[\d+\]|\Z)", sources, flags=re.S):
            for sentence in re.split(r"(?<=[.!?])\s+", said.strip()):
                scored.append((-len(asked & set(re.findall("[a-z0-9]+", sentence.lower()))), int(number), sentence))
        return " ".join(f"{s} [{n}]" for _, n, s in sorted(scored)[:3])

    def parse(self, system: str, user: str, fields: list[str], max_tokens: int = 1500) -> dict[str, object]:
        lines = [line for line in user.splitlines() if line.strip()]
        return {f: 3 if f in ("correctness", "faithfulness", "completeness") else (lines[0] if lines else "") if f == fields[0] else "; ".join(lines[1:4]) for f in fields}

    @staticmethod
    def _extract(text: str) -> dict[str, list[dict[str, object]]]:
        """Names in capitals, told apart by the words beside them, and what one sentence says of two of them."""
        kinds: dict[str, str] = {}
        relations: list[dict[str, object]] = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            here = []
            for m in re.finditer(r"(?<![\w-])(?:[A-Z][\w-]*[A-Z0-9]\w*|(?:[A-Z][a-z]+)(?: (?:[A-Z][\w-]*|of|\d+))+)", sentence):
                name = m[0].removesuffix(" of")
                before, after = sentence[: m.start()].lower().split()[-1:], sentence[m.end() :].lower().split()[:1]
                data = before in (["on"], ["dataset"], ["benchmark"], ["over"]) or after in (["dataset"], ["benchmark"], ["corpus"])
                kinds.setdefault(name, "Dataset" if data else "Method")
                here.append(name)
            methods, data = ([n for n in here if kinds[n] == kind] for kind in ("Method", "Dataset"))
            said = sentence.strip()[:300]
            if methods and data:
                predicate = "USES" if re.search(r"\bus(?:es|ed|ing)\b", sentence) and "evaluat" not in sentence else "EVALUATES_ON"
                relations += [{"subject": methods[0], "predicate": predicate, "object": d, "evidence": said, "confidence": 0.5} for d in data[:3]]
            if len(methods) > 1:
                predicate = "BUILDS_ON" if re.search(r"\b(?:build|extend|based)", sentence) else "COMPARES_TO" if re.search(r"\b(?:compar|outperform|than)", sentence) else None
                if predicate:
                    relations.append({"subject": methods[0], "predicate": predicate, "object": methods[1], "evidence": said, "confidence": 0.5})
        entities = [{"name": n, "type": kind, "aliases": [], "description": ""} for n, kind in list(kinds.items())[:60]]
        return {"entities": entities, "relations": relations[:40], "results": []}

    @staticmethod
    def _graph_query(question: str) -> str:
        words = re.findall(r"[A-Za-z0-9][\w.@-]*", question)
        labels = [label for w in words if (label := LABEL_WORDS.get(w.lower().rstrip("s")))]
        wanted = labels[0] if labels else "Method"
        names = [w for w in words if w.lower() not in _STOP and w.lower().rstrip("s") not in LABEL_WORDS]
        name = next((w for w in names if not w[0].islower()), max(names, key=len, default="")).lower().replace("'", "")
        shown = "count(DISTINCT a) AS n" if re.search(r"\bhow many|\bcount|\bnumber of", question, re.I) else "DISTINCT a.name AS name"
        return f"MATCH (a:{wanted})-[]-(b) WHERE toLower(b.name) CONTAINS '{name}' RETURN {shown} LIMIT 50"


REGISTRY: dict[str, Callable[[], Backend]] = {"rule": RuleBackend}


def make_backend(name: str = "rule") -> Backend:
    """A backend by its registered name; hosted models register here (K2)."""
    if name not in REGISTRY:
        raise ValueError(f"unknown backend {name!r}; registered: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


class TokenBucket:
    """`rate` calls a second with bursts of `burst`; clock and sleep can be replaced. One a task: rate / tasks each."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.level, self.at = float(burst), clock()

    def take(self) -> float:
        """Wait for a token; the seconds waited."""
        now = self.clock()
        self.level = min(self.burst, self.level + (now - self.at) * self.rate)
        wait = max(0.0, (1 - self.level) / self.rate)
        if wait:
            self.sleep(wait)
        self.at = now + wait
        self.level = max(0.0, self.level - 1 + wait * self.rate)
        return wait


def is_retryable(error: Exception) -> bool:
    """Rate limits, server errors and lost connections."""
    status = getattr(error, "status", None)
    return status == 429 or (status or 0) >= 500 or isinstance(error, (ConnectionError, TimeoutError))


def with_retry(call: Callable[[], str], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform) -> str:
    """`call` with full-jitter exponential back-off; a Retry-After of the error goes first."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if attempt == attempts - 1 or not is_retryable(error):
                raise
            after = getattr(error, "retry_after", None)
            sleep(min(CAP_S, after) if after is not None else draw(0, min(CAP_S, BASE_S * 2**attempt)))
    raise AssertionError


@dataclass(frozen=True)
class Usage:
    """Token counts; they add."""

    input: int = 0
    output: int = 0
    cache_read: int = 0
    cache_write: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.input + other.input, self.output + other.output, self.cache_read + other.cache_read, self.cache_write + other.cache_write)

    def cost(self, input_price: float, output_price: float) -> float:
        """Price of the counts at prices for a million tokens."""
        paid = (self.input + CACHE_WRITE * self.cache_write + CACHE_READ * self.cache_read) * input_price + self.output * output_price
        return paid / 1e6


@dataclass
class Meter:
    """Usage by stage, and a budget that every call is checked against before it is made (K7)."""

    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    limit: float | None = None
    run: str = ""
    rows: list[tuple[str, str, str, Usage]] = field(default_factory=list)

    def check(self) -> None:
        """BudgetExceeded if the limit is reached."""
        if self.limit is not None and self.cost() >= self.limit:
            raise BudgetExceeded(f"spent {self.cost():.4f} of {self.limit:.4f}")

    def record(self, stage: str, model: str, usage: Usage) -> None:
        self.rows.append((self.run, stage, model, usage))

    def cost(self) -> float:
        """Cost so far; unknown models cost nothing."""
        return sum(usage.cost(*self.prices[model]) for _, _, model, usage in self.rows if model in self.prices)

    def totals(self) -> dict[str, dict[str, float]]:
        """Calls, tokens and cost of each stage."""
        out: dict[str, dict[str, float]] = {}
        for _, stage, model, usage in self.rows:
            one = out.setdefault(stage, {"calls": 0, "tokens": 0, "cost": 0.0})
            one["calls"] += 1
            one["tokens"] += usage.input + usage.output
            one["cost"] += usage.cost(*self.prices[model]) if model in self.prices else 0.0
        return out

    @contextmanager
    def scoped(self, run: str) -> Iterator[Meter]:
        """A meter of one run with what is left of the limit; its rows come back to this one at the end, also after errors (K8)."""
        left = None if self.limit is None else max(0.0, self.limit - self.cost())
        inner = Meter(self.prices, left, run)
        try:
            yield inner
        finally:
            self.rows += inner.rows

    def write(self, path: str) -> None:
        """The totals as JSON."""
        with open(path, "w", encoding="utf-8") as file:
            json.dump({"stages": self.totals(), "cost": self.cost()}, file, indent=1)


@dataclass
class MeteredBackend:
    """A backend behind a budget, a rate and retries; each call is metered (K3)."""

    inner: Backend
    meter: Meter
    stage: str = ""
    model: str = "rule"
    bucket: TokenBucket | None = None
    sleep: Callable[[float], None] = time.sleep

    def _call(self, ask: Callable[[], object], said: str, max_tokens: int):
        self.meter.check()

        def once():
            if self.bucket:
                self.bucket.take()
            return ask()

        answer = with_retry(once, sleep=self.sleep)
        usage = getattr(self.inner, "usage", None)
        text = answer if isinstance(answer, str) else json.dumps(answer)
        self.meter.record(self.stage, self.model, usage or Usage(max(1, len(said) // 4), max(1, len(text) // 4)))
        if getattr(self.inner, "truncated", False):
            raise Truncated(f"cut at {max_tokens} tokens")
        return answer

    def complete(self, system: str, user: str, max_tokens: int = 1500) -> str:
        return self._call(lambda: self.inner.complete(system, user, max_tokens), system + user, max_tokens)

    def parse(self, system: str, user: str, fields: list[str], max_tokens: int = 1500) -> dict[str, object]:
        return self._call(lambda: self.inner.parse(system, user, fields, max_tokens), system + user, max_tokens)


def probe(backend: Backend, calls: int, clock: Callable[[], float] = time.monotonic) -> dict[str, float]:
    """Latency and rate of a backend over some calls, and how long a thousand would take (K9)."""
    took = []
    for number in range(calls):
        began = clock()
        backend.complete("Answer with one word.", f"ping {number}", 10)
        took.append(clock() - began)
    whole = sum(took)
    rate = calls / whole if whole > 0 else float("inf")
    return {"calls": calls, "median_s": median(took), "min_s": min(took), "max_s": max(took), "calls_a_second": rate, "s_a_thousand": 1000 / rate}


def usage_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """(stage, calls, tokens, cost) of usage rows (stage, model, input, output, cache_read, cache_write) (K6).

    `pricing` has model, input_price and output_price for a million tokens; unknown models cost nothing.
    """
    priced = usage.join(F.broadcast(pricing), "model", "left")
    paid = (F.col("input") + CACHE_WRITE * F.col("cache_write") + CACHE_READ * F.col("cache_read")) * F.col("input_price") + F.col("output") * F.col("output_price")
    return priced.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("input") + F.col("output")).alias("tokens"),
        F.round(F.sum(F.coalesce(paid, F.lit(0.0))) / 1e6, 6).alias("cost"),
    )

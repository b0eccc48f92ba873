import random

from pyspark.sql import functions as F

from scriptorium.functions.tokens import lexical_tokens, span_id, token_estimate
from scriptorium.operators import chunking, text


def one(spark, column, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column).first()[0]


def test_clean_text(spark):
    clean = lambda raw: one(spark, text.clean_text(F.col("x")), raw)
    assert clean("retrie-\nval works") == "retrieval works"
    assert clean("eﬃcient ﬁnding") == "efficient finding"
    assert clean("one line\ncontinues here\n\nnew paragraph") == "one line continues here\n\nnew paragraph"
    assert clean("a.  b\n\n\n\nc  ") == "a. b\n\nc"
    assert clean("") == "" and clean(None) is None


def test_sections_tile_the_text(spark):
    said = "Abstract\n\nsome text\n\n1 Introduction\n\nmore\n\n2. Related Work\n\nend"
    docs = spark.createDataFrame([("a", said), ("b", "no headings"), ("c", ""), ("d", None), ("e", "before\nResults:\nafter")], "k string, text string")
    rows = text.detect_sections(docs, "k").collect()
    by = {k: sorted([r for r in rows if r.k == k], key=lambda r: r.ordinal) for k in "abcde"}
    assert [r.title for r in by["a"]] == ["Abstract", "Introduction", "Related Work"]
    assert [r.title for r in by["b"]] == ["Body"] and [r.title for r in by["c"]] == ["Body"] and not by["d"]
    assert [r.title for r in by["e"]] == ["Front Matter", "Results"]
    for key, whole in (("a", said), ("b", "no headings")):
        ends = [(r.char_start, r.char_end) for r in by[key]]
        assert ends[0][0] == 0 and ends[-1][1] == len(whole)
        assert all(x[1] == y[0] for x, y in zip(ends, ends[1:]))


def test_reading_order(spark):
    block = "page int, width double, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
    rows = [
        (1, 600.0, 320.0, 100.0, 580.0, 150.0, "right one", 0), (1, 600.0, 20.0, 200.0, 280.0, 250.0, "left two", 0),
        (1, 600.0, 20.0, 100.0, 280.0, 150.0, "left one", 0), (1, 600.0, 320.0, 200.0, 580.0, 250.0, "right two", 0),
        (1, 600.0, 20.0, 40.0, 580.0, 60.0, "header", 0), (1, 600.0, 20.0, 400.0, 580.0, 460.0, "footer", 0),
        (2, 600.0, 20.0, 200.0, 580.0, 250.0, "second", 0), (2, 600.0, 20.0, 100.0, 580.0, 150.0, "first", 0), (2, 600.0, 0.0, 0.0, 9.0, 9.0, "image", 1),
    ]
    found = {r.page: r.text.split("\n") for r in text.reading_order(spark.createDataFrame(rows, block), "page", "width").collect()}
    assert found[1] == ["header", "left one", "left two", "right one", "right two", "footer"]
    assert found[2] == ["first", "second"]


def test_repeated_lines(spark):
    pages = spark.createDataFrame([("d", p, f"Journal of X\nbody {p}\nEnds with a stop.") for p in range(5)] + [("e", 0, "once")], "doc string, page int, text string")
    assert [r.line for r in text.repeated_lines(pages, "doc", "page", "text").collect()] == ["Journal of X"]
    kept = {(r.doc, r.page): r.text for r in text.strip_repeated_lines(pages, "doc", "page", "text").collect()}
    assert kept["d", 3] == "body 3\nEnds with a stop." and kept["e", 0] == "once"


def test_tokens_and_estimates(spark):
    assert one(spark, lexical_tokens(F.col("x")), "MS MARCO scored 78.4 on NQ") == ["ms", "marco", "scored", "78", "4", "on", "nq"]
    assert [one(spark, token_estimate(F.col("x")), v) for v in ("", " ", "one", "a b c", None)] == [0, 1, 1, 3, 0]
    assert len(one(spark, span_id(F.col("x"), F.lit(0), F.lit(5)), "p")) == 16


DOC = "\n\n".join(
    part
    for title, count in (("Introduction", 6), ("Experiments", 6), ("References", 4))
    for part in [title, *(f"Paragraph {i}. This sentence talks of retrieval. Another one follows it here." for i in range(count))]
)


def test_chunks_cover_the_document(spark):
    docs = spark.createDataFrame([("p", DOC), ("empty", ""), ("none", None), ("blank", " \n \n ")], "k string, text string")
    chunks = sorted(chunking.build_chunks(docs, "k", target=60, overlap=10).collect(), key=lambda c: c.char_start)
    assert {c.paper_id for c in chunks} == {"p"} and len({c.chunk_id for c in chunks}) == len(chunks) > 2
    assert chunks[0].char_start == 0 and chunks[-1].char_end == len(DOC) and chunks[0].section == "Introduction"
    assert all(DOC[c.char_start : c.char_end] == c.text for c in chunks)
    assert all(not DOC[a.char_end : b.char_start].strip() for a, b in zip(chunks, chunks[1:]))
    windows = chunking.build_windows(docs, "k", target=400, overlap=20).collect()
    assert 0 < len(windows) < len(chunks) and all("References" not in w.sections for w in windows)


def test_oversized_paragraph_is_split():
    giant = " ".join(f"Sentence number {i} about retrieval systems." for i in range(300))
    units = chunking.pack(giant, chunking.paragraph_spans(giant), 100, 10)
    assert len(units) > 1 and all(text.estimate_tokens(giant[a:b]) < 400 for a, b in units)
    pieces = chunking.sentence_spans(giant, (0, len(giant)), 100)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(giant) and all(x[1] == y[0] for x, y in zip(pieces, pieces[1:]))


def test_tiles_equal_the_native_sections(spark):
    rng = random.Random(4)
    lines = ["Abstract", "1 Introduction", "2.1 Related work:", "RESULTS:", "Conclusion.", "plain line", "", "  III. Method  ", "A Data-driven view", "x" * 90, "7 Ab", "3 " + "Long " * 20]
    docs = {f"d{i}": "\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for i in range(60)}
    rows = text.detect_sections(spark.createDataFrame(list(docs.items()), "k string, text string"), "k").collect()
    for key, said in docs.items():
        assert [(r.title, r.char_start, r.char_end) for r in sorted((r for r in rows if r.k == key), key=lambda r: r.ordinal)] == text.section_tiles(said)
    assert [t for t, _, _ in text.section_tiles("2.1 Related work:\nx")] == ["Related work"]


def test_packing_equals_a_running_budget():
    rng = random.Random(9)
    for _ in range(200):
        words = [" ".join(["w"] * rng.randrange(1, 30)) for _ in range(rng.randrange(1, 25))]
        said, spans = "\n\n".join(words), []
        spans = chunking.paragraph_spans(said)
        target, overlap = rng.randrange(10, 60), rng.randrange(0, 30)
        atoms = [p for s in spans for p in (chunking.sentence_spans(said, s, target) if text.estimate_tokens(said[s[0] : s[1]]) > target else [s])]
        costs = [text.estimate_tokens(said[a:b]) for a, b in atoms]
        want, held = [], []
        for i in range(len(atoms)):
            if held and sum(costs[j] for j in held) + costs[i] > target:
                want.append((atoms[held[0]][0], atoms[held[-1]][1]))
                while held and sum(costs[j] for j in held) > overlap:
                    held = held[1:]
            held = [*held, i]
        assert chunking.pack(said, spans, target, overlap) == [*want, (atoms[held[0]][0], atoms[held[-1]][1])]


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(f"p{i}", DOC) for i in range(40)], "k string, text string").repartition(8)
    assert "Exchange" not in chunking.build_chunks(docs, "k")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_pages_to_text(spark):
    block = "doc string, page int, width double, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
    rows = [("a", p, 600.0, 20.0, y, 580.0, y + 10, said, 0) for p in range(5) for y, said in ((1.0, "Journal"), (50.0, f"Page {p} says retrie-"), (80.0, "val works. " * 20))]
    rows += [("b", 0, 600.0, 20.0, 1.0, 580.0, 9.0, "too short", 0)]
    got = text.parse_pages(spark.createDataFrame(rows, block), "doc", "page", "width").collect()
    assert [r.doc for r in got] == ["a"] and "Journal" not in got[0].text and "Page 3 says retrieval works." in got[0].text

import itertools
import os
import random
import re
import threading

import numpy as np
import pytest

from scriptorium.llm import canonlist, leaks, names, neardup
from scriptorium.sources.tables import shared_folder


# ---- problem 1
def test_golay_table_is_perfect():
    table = neardup.golay_table()
    assert np.bincount(table).tolist() == [2048] * 4096


def test_vectors_two_bits_apart_share_a_key():
    rng = random.Random(1)
    for _ in range(2000):
        v = rng.randrange(1 << 23)
        w = v ^ (1 << rng.randrange(23)) ^ (1 << rng.randrange(23))
        _, a = neardup.golay_keys(np.array([v]))
        _, b = neardup.golay_keys(np.array([w]))
        assert set(a) & set(b) and len(a) in (1, 6)


def brute_pairs(texts, shingle, similarity, least):
    sets = {}
    for key, text in texts.items():
        words = re.findall("[a-z0-9]+", (text or "").lower())
        if len(words) >= max(least, shingle):
            sets[key] = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity - 1e-12}


def variants(rng, n, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    base = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(n)]
    for i, b in enumerate(base):
        texts[f"b{i:03}"] = " ".join(b)
        for j in range(rng.randrange(4)):
            edited = list(b)
            for _ in range(rng.randrange(6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts[f"b{i:03}v{j}"] = " ".join(edited)
    return texts


@pytest.mark.parametrize("hot", [None, 2, 0])
def test_pairs_equal_brute_force(spark, hot):
    texts = variants(random.Random(5), 60) | {"null": None, "empty": "", "short": "a b c", "copy1": "x y z " * 20, "copy2": "x y z " * 20}
    rows = [(k, t, "c") for k, t in texts.items()]
    frame = spark.createDataFrame(rows + rows[:5], "k string, text string, class string")
    membership, links = neardup.similar_classes(frame, "k", "text", shingle_words=3, similarity=0.6, least_words=20, hot=hot)
    got = {tuple(r) for r in neardup.member_pairs(membership, links).collect()}
    assert got == brute_pairs(texts, 3, 0.6, 20) and ("copy1", "copy2") in got


@pytest.mark.parametrize("rows,pairs", [(1, 1), (7, 3)])
def test_small_steps_change_nothing(spark, monkeypatch, rows, pairs):
    monkeypatch.setattr(neardup, "ROWS_AT_ONCE", rows)
    monkeypatch.setattr(neardup, "PAIRS_AT_ONCE", pairs)
    texts = {k: t for k, t in variants(random.Random(6), 12).items()}
    sets = [np.unique(neardup.shingle_hashes(neardup.word_hashes(t), 3).view(np.int64)) for t in texts.values()]
    anchors, vectors = neardup.segments(sets, 24)
    sketch, n = neardup.sketches(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), 24)
    order = np.argsort(anchors.ravel(), kind="stable")
    met = neardup._met(anchors.ravel()[order], owner[order], vectors.ravel()[order].astype(np.int64), n[owner[order]], sketch[owner[order]], 0.6)
    found = {tuple(p) for part in met for p in part.tolist()}
    keys = list(texts)
    assert brute_pairs(texts, 3, 0.6, 20) <= {tuple(sorted((keys[a], keys[b]))) for a, b in found}


def test_no_rows_no_pairs(spark):
    membership, links = neardup.similar_classes(spark.createDataFrame([], "k string, text string"), "k", "text")
    assert membership.count() == 0 and links.count() == 0


def test_bands_replace_crowded_ones():
    anchors = np.array([[1, 2, 3, 4, 5, 6], [9, 2, 3, 4, 5, 6], [9, 2, 3, 4, 9, 6], [1, 2, 3, 9, 9, 9]])
    mask, few = neardup.chosen_bands(anchors, np.array([7, 9]), 3)
    assert mask.astype(int).tolist() == [[1, 1, 1, 0, 0, 0], [0, 1, 1, 1, 1, 0], [0, 1, 1, 1, 0, 1], [1, 1, 1, 0, 0, 0]]
    assert few.tolist() == [False, False, False, False]
    mask, few = neardup.chosen_bands(anchors, np.array([3, 9]), 3)
    assert few.tolist() == [False, True, True, True] and mask[3].tolist() == [True, True, False, False, False, False]
    assert neardup.chosen_bands(anchors, np.array([], dtype=np.int64), 3)[0].sum() == 12


@pytest.mark.parametrize("hot", [None, 20])
def test_disk_stays_below_four_times_the_input(spark, tmp_path, hot):
    rng, vocabulary = random.Random(8), [f"word{i}" for i in range(3000)]
    phrases = [" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choice(phrases) if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(90)) for _ in range(6000)]
    texts += [" ".join(t.split()[:-3]) for t in texts[:600]]
    spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    frame = spark.read.parquet(str(tmp_path / "in")).repartition(4).localCheckpoint()
    size = lambda *folders: sum(_size(os.path.join(at, f)) for x in folders for at, _, files in os.walk(x) for f in files)
    places = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_folder(spark).removeprefix("file:")]
    base, most, done = size(*places), [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            most[0] = max(most[0], size(*places) - base)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        membership, links = neardup.similar_classes(frame, "k", "text", shingle_words=3, similarity=0.6, least_words=20, hot=hot)
        found = links.count()
    finally:
        done.set()
        watcher.join()
    assert found >= 600 and 0 < most[0] < 4 * size(str(tmp_path / "in"))


def _size(path):
    try:
        return os.path.getsize(path)
    except OSError:
        return 0


# ---- problem 8
def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(50)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", say(rng.randrange(5, 40)), say(30) if k % 3 else None, "x") for k in range(12)] + [("null", None, "", "x")]
    docs = [(k, say(60), "x") for k in range(20)] + [(100, None, "x"), (101, "", "x")]
    for k in range(40):
        words = (rng.choice(items[:12])[1 + rng.randrange(2)] or "").split()
        cut = words[rng.randrange(4) :][: rng.randrange(8, 20)]
        docs.append((200 + k, say(5) + " " + ", ".join(cut).upper() + "! " + say(5), "x"))
    docs += docs[:3]
    want = set()
    for doc, text, _ in docs:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        grams = {tuple(words[i : i + 12]) for i in range(len(words) - 11)}
        for item, q, r, _ in items:
            for said in (q, r):
                w = re.findall("[a-z0-9]+", (said or "").lower())
                if any(tuple(w[i : i + 12]) in grams for i in range(len(w) - 11)):
                    want.add((doc, item))
    corpus = spark.createDataFrame(docs, "doc_id int, text string, prefix string")
    held = spark.createDataFrame(items, "id string, question string, reference string, window string")
    find = lambda c, h: {tuple(r) for r in leaks.leaked_passages(c, "doc_id", "text", h, "id", ["question", "reference"]).collect()}
    assert want and find(corpus, held) == want
    assert not find(corpus.limit(0), held) and not find(corpus, held.limit(0))


def test_leaks_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SENT_SHINGLES", 1)
    said = " ".join(f"w{i}" for i in range(20))
    corpus = spark.createDataFrame([(1, said), (2, said[10:40])], "doc_id int, text string")
    held = spark.createDataFrame([("a", said)], "id string, question string")
    assert [tuple(r) for r in leaks.leaked_passages(corpus, "doc_id", "text", held, "id", ["question"]).collect()] == [(1, "a")]


# ---- problem 2
ENTRIES = [(1, "Corvid Questions v1"), (2, "Corvid Questions v2"), (3, "Harbor QA"), (4, "Nightjar"), (5, "Slatewater 500"), (6, "Slatewater 5000"), (7, "Tundra Web Passages")]


@pytest.mark.parametrize(
    "value,entry",
    [("corvid questions v1", 1), ("Corvid_Questions_v2", 2), ("CorvidQuestionsv1", 1), ("Corvid Ques. v1", 1), ("Corvid Questions v8", -1), ("Covrid Questions v1", 1), ("the the Nightjar", 4),
     ("Nighhtjar dataset", 4), ("QA, Harbor", 3), ("TWP", 7), ("Web Passages Tundra", 7), ("Tundra Web Passages (dev) [full]", 7), ("SLATEWATER 5000", 6), ("Slatewater 50", -1), ("n/a", -1), ("(ours)", -1),
     ("Yarrowdale Gauntlet", -1), ("Tundra_Web_Passages_corpus", 7), ("Harbor QA bencheark", 3), ("ＴＵＮＤＲＡ Web Passages", 7)],
)
def test_values(value, entry):
    assert canonlist.Matcher(ENTRIES).match(value) == entry


def test_trie_finds_what_a_full_scan_finds():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 16))) for _ in range(150)}
    trie = canonlist.Trie()
    for i, w in enumerate(sorted(words)):
        trie.add(w, i, 0)

    def distance(a, b):
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for w in sorted(words)[:40]:
        typed = "".join(c for c in w if rng.random() > 0.1) + rng.choice(["", "a", "x"])
        want = {(distance(typed, v), 0, i) for i, v in enumerate(sorted(words)) if distance(typed, v) <= canonlist.bound(len(v))}
        assert set(trie.search(typed, 3)) == want


METRICS = [(1, "Exact Match"), (2, "Recall@20"), (3, "Recall@100"), (4, "Throughput"), (5, "Training Time"), (6, "Faithfulness"), (7, "Query Latency")]


@pytest.mark.parametrize("value,entry", [("thruput", 4), ("qry ltncy", 7), ("Traning Time (ms)", 5), ("Querry Latency (ms)", 7), ("Recal@100", 3), ("reccall@20 (%)", 2), ("Fathfulness", 6), ("toxicity", -1), ("time", -1)])
def test_unseen_typos_and_contractions(value, entry):
    units = {"ms", "%"}
    assert canonlist.Matcher(METRICS, {}, units).match(value) == entry


def test_recall_with_unseen_typos():
    rng = random.Random(11)
    matcher, good, total = canonlist.Matcher(ENTRIES), 0, 0
    for entry, name in ENTRIES:
        for _ in range(40):
            i = rng.randrange(1, len(name) - 5)
            typed = rng.choice([name[:i] + name[i + 1 :], name[: i - 1] + name[i] + name[i - 1] + name[i + 1 :], name[:i] + rng.choice("abcdefgh") + name[i:]])
            total, good = total + 1, good + (matcher.match(typed) == entry)
    assert good / total >= 0.98


def test_blocks_do_not_change_the_result(spark):
    typed = ["covrid questions v1", "Harbr QA", "TWP", "slatewater 5000", "nothing here", "Nightjar corpus", "Tundra Web Pasages"]
    claims = spark.createDataFrame([(i, v) for i, v in enumerate(typed)], "claim_id int, dataset string")
    terms = spark.createDataFrame([(i, "dataset", n) for i, n in ENTRIES] + [(99, "dataset", "Harbor QA")], "term_id int, field string, canonical string")
    few, many = ({tuple(r) for r in canonlist.map_to_terms(claims, "claim_id", ["dataset"], terms, entries_a_trie=n).collect()} for n in (2, 1000))
    assert few == many and (1, "dataset", 3) in many and (4, "dataset", -1) in many
    near = {(r.value, r.term_id): r.distance for r in canonlist.near_terms(claims, "claim_id", ["dataset"], terms).collect()}
    assert near["Harbr QA", 3] == near["Harbr QA", 99] == 1 and near["covrid questions v1", 1] == 1 and ("nothing here", 3) not in near


def test_map_to_terms(spark):
    claims = spark.createDataFrame([(1, "Harbor QA", "acc", None), (2, "harbor qa", None, "x"), (2, "harbor qa", None, "x"), (3, "  ", "", "x"), (4, "what", "Recall at 20 (%)", "x")], "claim_id int, dataset string, metric string, term_id string")
    terms = spark.createDataFrame([(3, "dataset", "Harbor QA"), (9, "metric", "Accuracy"), (8, "metric", "Recall@20")], "term_id int, field string, canonical string")
    got = {tuple(r) for r in canonlist.map_to_terms(claims, "claim_id", ["dataset", "metric"], terms).collect()}
    assert got == {(1, "metric", 9), (2, "dataset", 3), (4, "dataset", -1), (4, "metric", 8)}
    assert canonlist.map_to_terms(claims.limit(0), "claim_id", ["dataset"], terms).count() == 0


# ---- problem 3
def test_lcs_ratio():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return 2 * d[-1][-1] / (len(a) + len(b)) if a and b else 0.0

    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert names.lcs_ratio(a, b) == pytest.approx(slow(a, b))


def test_suffix_heads_lose_no_pair():
    rng = random.Random(8)
    for ratio in (names.RATIO_NAME, names.RATIO_SECOND):
        for _ in range(600):
            a = "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 17)))
            b = "".join(rng.choice(["", c, c, c, c, c, c, rng.choice("abcde"), c + rng.choice("abcde")]) for c in a)
            if a != b and names.lcs_ratio(a, b) >= ratio:
                x, y = list(names.suffix_heads(a, ratio)), list(names.suffix_heads(b, ratio))
                met = [(p, q) for p in x for q in y if p[0] == q[0] and p[1] != q[1]]
                assert any(-(p[3] if p[1] else p[4]) <= q[2] - p[2] <= (p[4] if p[1] else p[3]) for p, q in met), (a, b)
                assert (names.letters(a) ^ names.letters(b)).bit_count() <= met[0][0][3] + met[0][0][4]


def brute_forms(rng):
    slip = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :], w[:i] + rng.choice("aeiou") + w[i:]]))(rng.randrange(1, len(w)))
    given = ["".join(rng.choice("bdfklmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(60)]
    rows = {(f, g) for f in ("pobagabab", "pobagabeb") for g in given} | {("pobagabab", "susan"), ("pobagabab", "snsan"), ("lakijafeb", "mira"), ("lkaijafeb", "mira"), ("lakijafbe", "miar")}
    rows |= {(slip(f), slip(g)) for f, g in sorted(rows)}
    return [(f"P {g} {f}", f, g) for f, g in sorted(rows)] + [("O university pobagabab", "pobagabab", "university"), ("O research pobagabab", "pobagabab", "research")]


@pytest.mark.parametrize("common", [None, 2, 0])
def test_links_equal_brute_force(spark, common):
    forms = brute_forms(random.Random(9))
    want = {tuple(sorted((a, b))) for a, p, q in forms for b, r, s in forms if a < b and a[0] == b[0] and names.lcs_ratio(p, r) >= names.RATIO_NAME and names.lcs_ratio(q, s) >= names.RATIO_SECOND}
    got = [tuple(r) for r in names.link_forms(spark.createDataFrame(forms, "form string, x1 string, x2 string"), common).collect()]
    assert set(got) == want and len(got) == len(want) and ("P snsan pobagabab", "P susan pobagabab") in want


def test_a_common_name_loses_no_link(spark):
    many = [(f"P {g} {f}", f, g) for f in ("ashcombford",) for g in ("".join(p) for p in itertools.product("bdk", "aei", "mnr", "o"))]
    forms = [*many, ("P jonathan ashcombford", "ashcombford", "jonathan"), ("P ojnathan sahcombford", "sahcombford", "ojnathan")]
    got = {tuple(r) for r in names.link_forms(spark.createDataFrame(forms, "form string, x1 string, x2 string"), 5).collect()}
    assert ("P jonathan ashcombford", "P ojnathan sahcombford") in got


PEOPLE = [
    ["Susan Pobagabab", "Pobagabab, Susan", "POBAGABAB, Susan", "S. Pobagabab", "Pobagabab S", "Sue Pobagabab", "Pobagabab Susan", "Ssuan Pobagabab", "Susan Pobagatab", "Dr. Susan Pobagabab", "Susan  Pobagabab "],
    ["Kenji Vanaseket", "K. Vanaseket", "Kenj. Vanaseket", "kenji vanaseket", "Vanaseket KE"],
    ["William Vanaseket", "Will Vanaseket", "Vanaseket, W. T."],
    ["Thomas de Habogefos", "THOMAS DE HABOGEFOS", "de Habogefos, T."],
    ["Mira Jazivotin", "Jazivotin MS", "Mіrа Jazivotin"],
]
PLACES = [
    ["University of Dejabatia", "Dejabatia Univ.", "U. of Dejabatia", "univ of dejabattia", "DejabatUA", "The University of Dejabatia", "MIT"],
    ["Dejabatia Research Laboratory", "Research Laboratory of Dejabatia", "Dejabatia Res. Lab.", "DejabatRLA"],
    ["Sehisoxund Institute of Technology", "Inst. Technol. Sehisoxund", "Technology Institute, Sehisoxund"],
    ["Zibavivford Analytics GmbH", "Ziabvivford Analytics G.m.b.H.", "Zibavivford Analytic Inc."],
]


def pairs_of(groups):
    return {tuple(sorted((a, b), key=lambda s: s.encode())) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]}


def test_persons(spark):
    strings = [(s, 5 if i == 0 else 1) for g in PEOPLE for i, s in enumerate(g)] + [("et al.", 3), ("", 1), ("  ", 1)]
    got = {tuple(r) for r in names.spelling_pairs(names.link_persons(spark.createDataFrame(strings, "s string, n bigint"))).collect()}
    assert got == pairs_of(PEOPLE)
    assert names.link_persons(spark.createDataFrame([], "s string, n bigint")).count() == 0


def test_organisations_and_their_rows(spark):
    strings = [(s, 5 if i == 0 else 1) for g in PLACES for i, s in enumerate(g)] + [("et al.", 3), ("", 1), ("Elsewhere", 1)]
    rows = [("O", g[0], s) for g in PLACES for s in g if s in ("DejabatUA", "DejabatRLA", "MIT")] * 2 + [("O", PLACES[0][0], "DejabatRLA"), ("O", None, "DejabatUA"), ("O", PLACES[0][0], None)]
    frame, aliases = spark.createDataFrame(strings, "s string, n bigint"), spark.createDataFrame(rows, "kind string, name string, alias string")
    got = {tuple(r) for r in names.spelling_pairs(names.link_names(None, frame, aliases)).collect()}
    assert got == pairs_of(PLACES)
    assert names.link_organisations(frame.limit(0)).count() == 0


def test_a_misspelling_joins_no_two_names(spark):
    forms = spark.createDataFrame([("P1", "zibavivford", "u", 50), ("P2", "zobibavford", "u", 40), ("T1", "zibavvford", "u", 1), ("T2", "zobbavford", "u", 1), ("M", "zibbavford", "u", 1), ("A", "lakijafeb", "u", 1), ("B", "lakijafb", "u", 1)], "form string, x1 string, x2 string, n bigint")
    links = spark.createDataFrame([("P1", "T1"), ("P1", "M"), ("M", "P2"), ("P2", "T2"), ("M", "T2"), ("A", "B")], "a string, b string")
    got = {r.a: r.b for r in names.nearest_links(links, forms).collect()}
    assert got["T1"] == "P1" and got["T2"] == "P2" and got["M"] == "T2" and {got["A"], got["B"]} == {"A", "B"}


def test_rows_decide_initials(spark):
    strings = spark.createDataFrame([("Yusuf Livofazaf", 9), ("Yara Livofazaf", 1), ("Y. Livofazaf", 2), ("Yezda Hollis", 1), ("Ms Ezz", 1)], "s string, n bigint")
    aliases = spark.createDataFrame([("P", "Yara Livofazaf", "Y. Livofazaf"), ("P", "Yezda Hollis", "Ezz")], "kind string, name string, alias string")
    got = {r.s: r.entity for r in names.link_names(strings, None, aliases).collect()}
    assert got["Y. Livofazaf"] == got["Yara Livofazaf"] != got["Yusuf Livofazaf"]

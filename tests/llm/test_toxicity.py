import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import toxicity as tox
from gridloom.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


WORDS, STEMS = ["trash", "moron", "disgusting", "ape"], ["vequ", "lostra"]


def brute(word):
    found = [d for w in WORDS if (d := distance(word, w)) <= tox.edits_for(len(w))]
    found += [d for s in STEMS for k in range(len(word) + 1) if (d := distance(word[:k], s)) <= tox.edits_for(len(s))]
    return min(found, default=None)


def test_automaton_finds_all_near_words():
    a = tox.Automaton(WORDS, STEMS)
    tried = set(itertools.chain(WORDS, STEMS, ["", "a"]))
    for w in WORDS + [s + "xy" for s in STEMS]:
        for i in range(len(w) + 1):
            tried |= {w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + w[i + 2:], w[:i] + "zz" + w[i:]}
    for w in tried:
        assert a.edits(w) == brute(w), w


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="trashmonvequlp", max_size=9))
def test_automaton_on_any_word(word):
    assert tox.Automaton(WORDS, STEMS).edits(word) == brute(word)


def test_quotation_is_told_from_abuse():
    m = tox.Matcher(tox.Model(tuple(WORDS), tuple(STEMS), frozenset({"crash"}), ()))
    meant, hits = tox.features("You are trash, you m0ron", m)
    assert [h[1] for h in hits] == [0, 1] and meant[1] > 0.9 and meant[2] == 0
    said, hits = tox.features('He said "trash and moron" in the interview', m)
    assert [round(h[2], 3) for h in hits] == [1.0, 1.0] and said[1] == 0 and said[2] > 0
    assert tox.features("a crash", m)[1] == [] and tox.features(None, m)[1] == [] and tox.features("", m)[1] == []


@pytest.fixture
def fitted(spark):
    rng = np.random.default_rng(1)
    vocab = ["w%s" % "".join(rng.choice(list("abcde"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = list(rng.choice(vocab, 40))
        toxic = i % 5 == 0
        if toxic:
            words[int(rng.integers(40))] = ["rotten", "filthy"][i % 2]
            words[int(rng.integers(40))] = "grumb" + "".join(rng.choice(list("xyz"), 3))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), vocab


def test_fit_and_score(spark, fitted, rows):
    docs, labels, vocab = fitted
    model = tox.fit(docs, labels)
    assert set(model.words) == {"rotten", "filthy"} and any(s.startswith("gru") and "grumb".startswith(s) for s in model.stems)
    odd = [(1, None), (2, ""), (3, "you are rotten and filthy grumbxyx"), (4, "you are r0tten and filhty"), (5, " ".join(vocab)), (6, " ".join(vocab) * 300), (7, "x" * 100000), (None, "fine"), (5, "fine"), (5, "fine")]
    df = spark.createDataFrame([(*r, 9) for r in odd], "doc_id long, text string, score int")
    got = rows(tox.score(df, model))
    assert [r["score"] for r in got] == [9] * len(odd)
    out = [r["toxicity"]["score"] for r in got]
    assert all(0 <= s <= 1 for s in out) and [s >= 0.5 for s in out] == [False, False, True] + [out[3] >= 0.5] + [False] * 6
    assert out[0] == out[1] and out[8] == out[9]
    assert tox.score(df.limit(0), model).count() == 0


def test_copies_and_shared_passages_make_no_entries(spark, fitted):
    docs, labels, vocab = fitted
    odd = " ".join(np.random.default_rng(2).choice(list("hijklmnop"), (40, 8)).view("U1").reshape(40, 8).astype(object).sum(axis=1))
    copies = spark.createDataFrame([(10000 + i, f"{odd} rotten x{i % 3}") for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(10000 + i, 1, 1) for i in range(300)], "doc_id long, quality int, toxic int")
    model = tox.fit(docs.union(copies), labels.union(marks))
    assert set(model.words) <= {"rotten", "filthy"} and all("grumb".startswith(s) or s.startswith("gru") for s in model.stems)


def test_misspellings_add_up(spark, fitted, rows):
    docs, labels, vocab = fitted
    df = spark.createDataFrame([(1, "r0tten filthhy rottn filtthy you rottten fiilthy"), (2, " ".join(["rooten", *vocab[:80]]))], "doc_id long, text string")
    got = rows(tox.score(df, tox.fit(docs, labels)))
    assert got[0]["toxicity"]["misspelt"] == 6 and got[0]["toxicity"]["score"] > 0.5 > got[1]["toxicity"]["score"]


def test_no_labels(spark, fitted, rows):
    docs, labels, _ = fitted
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("toxic", F.lit(0))):
        assert {r["toxicity"]["score"] < 0.01 for r in rows(tox.score(docs.limit(3), tox.fit(docs, none)))} == {True}


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and len(rows) > 50
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def swapped(a, b):
    """Edits where two neighbouring letters in the wrong order are one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_swaps_are_one_edit():
    a = tox.Automaton(WORDS, STEMS, swaps=True)
    tried = {w[:i] + w[i + 1] + w[i] + w[i + 2:] for w in WORDS + [s + "xy" for s in STEMS] for i in range(len(w) - 1)}
    tried |= {w[:i] + w[i + 1] + w[i] + w[i + 2:] for w in tried for i in range(len(w) - 1)}
    for w in tried:
        found = [d for x in WORDS if (d := swapped(w, x)) <= tox.edits_for(len(x))]
        found += [d for s in STEMS for k in range(len(w) + 1) if (d := swapped(w[:k], s)) <= tox.edits_for(len(s))]
        assert a.edits(w) == min(found, default=None), w


def test_disguised_words():
    m = tox.Matcher(tox.Model(("idiot", "stupid", "loser", "scum"), (), frozenset({"scmu", "x*y"}), ()))
    for text in ("idoit", "stpuid", "lsoer", "scuum", "looooser", "id!ot", "stup*d", "sc*m", "scu m idiot!you", "csum"):
        assert len(tox.features(text, m)[1]) == 1, text
    assert tox.features("scmu x*y a+b user@scam", m)[1] == []


def test_swapped_word_is_misspelt(spark, fitted, rows):
    docs, labels, vocab = fitted
    df = spark.createDataFrame([(4, "you are r0tten and filhty"), (5, "you are ro*ten and fil!hy")], "doc_id long, text string")
    got = rows(tox.score(df, tox.fit(docs, labels)))
    assert [(r["toxicity"]["hits"], r["toxicity"]["misspelt"], r["toxicity"]["score"] >= 0.5) for r in got] == [(2, 2, True)] * 2


def test_long_quotations():
    m = tox.Matcher(tox.Model(tuple(WORDS), (), frozenset(), ()))
    long = "trash " + "words and lines\n" * 60 + "moron"
    for a, b in ("“”", "«»", "„“", '""'):
        hits = tox.features(f"He said {a}{long}{b} and left, moron", m)[1]
        assert [round(h[2], 1) for h in hits] == [1.0, 0.7, 0.0], a
    hits = tox.features('"trash that is never closed\n\nmoron. “one «two» moron” disgusting 5" trash', m)[1]
    assert [h[2] > 0.5 for h in hits] == [True, False, True, False, False]
    assert tox.quotations('a "b "c" d" e') == [(2, 8)] and tox.quotations("") == [] and tox.quotations("x” y» z") == []


def test_large_lexicon_and_long_words(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    name = lambda n: "".join(rng.choice(letters, n))
    bad, fine = [name(9) for _ in range(2300)] + [name(80)], [name(6) for _ in range(300)]
    rows, labels = [], []
    for i in range(1600):
        rows.append((i, " ".join(rng.choice(fine, 200))))
        labels.append((i, 1, 0))
    for i in range(1600, 2000):
        words = [x for w in rng.permutation(bad)[:900] for x in (rng.choice(fine), w)] + [rng.choice(fine), bad[-1]]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, 1))
    model = tox.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    known = lambda w: w in model.words or any(w.startswith(s) for s in model.stems)
    assert len(model.words) > 2000 and all(known(w) for w in bad) and bad[-1] in model.words


def test_states_are_bounded():
    model = tox.Model(("rotten", "filthy"), ("idiot",), frozenset(), (0.0,) * 5)
    few, many = tox.Matcher(model, most=5, most_states=20), tox.Matcher(model)
    words = ["rotten", "roten", "filthy", "filhty", "idiotic", "idoit", "house", "fil", "rottn", "it", "thirty"] * 3
    for w in words:
        assert few[w] == many[w]
        assert len(few.automaton.states) < 20 + 20 and len(few) <= 5

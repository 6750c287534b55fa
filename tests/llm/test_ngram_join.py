import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import ngram_join, shingles
from gridloom.llm.queries import QUERIES

T = "doc_id long, text string"


def brute_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def ours(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 6)))
    passage = " ".join(word() for _ in range(60))
    base = [[word() for _ in range(n)] for n in (4, 5, 9, 40, 120, 300)]
    rows, i = [], 0
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = word()
            rows.append((i, ("\t" if i % 2 else " ").join(w).upper() if i % 3 else " ".join(w)))
            i += 1
    chain = [word() for _ in range(200)]
    for _ in range(30):  # each like the one before, the ends unlike
        rows.append((i, " ".join(chain)))
        chain = chain[3:] + [word() for _ in range(3)]
        i += 1
    for _ in range(40):
        rows.append((i, passage + " " + " ".join(word() for _ in range(rnd.randrange(0, 60)))))
        i += 1
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "a b c d"), (None, "a b c d"), (None, None)]
    rows += [(1007, "É é x")] * 3 + [(1008, " ".join(word() for _ in range(30000)))] + [(1009, "x" * 300000)]
    return rows


def test_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], T + ", cls string, n int").repartition(3)
    assert ours(ngram_join.join_documents(df)) == brute(rows)


def test_blocks_of_a_large_tile(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = [(i, " ".join(base[:k] + [word()] + base[k + 1:])) for i in range(60) for k in [rnd.randrange(100)]]
    rows += [(100 + i, " ".join(base[: 50 + i] + [word() for _ in range(50 - i)])) for i in range(45)]
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "FEW", 4)
    assert ours(ngram_join.join_documents(spark.createDataFrame(rows, T))) == brute(rows)


def test_empty(spark):
    assert ngram_join.join_documents(spark.createDataFrame([], T)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAb \t\n\x0b\x0c\r\x1cé🙂 ", max_size=60))
def test_shingle_numbers(text):
    h = shingles.shingle_set(np.frombuffer(text.encode(), dtype=np.uint8))
    assert len(h) == len(brute_set(text)) and (np.diff(h.astype(object)) > 0).all()


def test_parts_of_a_long_text(monkeypatch):
    data = np.frombuffer((" ab c" * 5000 + "x" * 5000 + " y" * 3000).encode(), dtype=np.uint8)
    want = shingles.shingle_set(data)
    monkeypatch.setattr(shingles, "_PART", 64)
    assert (shingles.shingle_set(data) == want).all()


def test_bound_is_above():
    rnd = np.random.default_rng(1)
    sets = [np.sort(rnd.choice(400, rnd.integers(110, 150), replace=False)).astype(np.uint64) for _ in range(60)]
    signatures = ngram_join.Signatures([ngram_join.signature(h) for h in sets])
    assert len(set(signatures.words.tolist())) == 2
    a, b = (v.ravel() for v in np.indices((60, 60)))
    n = np.array([len(h) for h in sets])
    got = signatures.bound(a, b, n[a], n[b])
    assert all(g >= len(np.intersect1d(sets[i], sets[j])) for g, i, j in zip(got, a, b)) and (got[a == b] == n).all()
    assert (got < np.minimum(n[a], n[b])).mean() > 0.9


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert ours(QUERIES["op4_ngram_jaccard_join"](spark, sf)) == brute(rows)


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, f"c{i}", 1) for i, r in enumerate(rows)], T + ", cls string, n int").repartition(3)
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    kept = sorted([(r.doc_id, r.text) for r in got.collect()], key=str)
    component = {}
    for (d, t), (_, n, c) in zip(sorted(rows, key=lambda r: str((r[0], len(brute_set(r[1]))))), brute(rows)):
        component.setdefault((n > 0, c), []).append((d, t))
    for (words, c), members in component.items():
        if words:
            stay = [m for m in members if m in kept]
            assert [d for d, _ in stay][:1] == [c] and kept.count(stay[0]) == 1 and len(set(stay)) == 1
        else:
            assert all(m in kept for m in members)
    assert len(kept) == len([1 for w, _ in component if w]) + sum(len(m) for (w, _), m in component.items() if not w)
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_keep_one_without_copies(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, None)], T)
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == [1, 2, 3]


def test_number_of_links(spark, monkeypatch):
    rows = corpus()
    sets = [brute_set(t) for _, t in rows]
    similar = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    want = sorted(((d, len(s), sum(similar(s, t) for t in sets) - bool(s)) for (d, _), s in zip(rows, sets)), key=str)
    df = spark.createDataFrame(rows, T).repartition(3)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    got = ngram_join.join_documents(df, count_links=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=str) == want
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    different = list(set(sets))
    _, links = ngram_join.classes(df, every=True)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert len(set(pairs)) == len(pairs) == sum(similar(a, b) for k, a in enumerate(different) for b in different[k + 1:])
    assert ngram_join.join_documents(df.limit(0), count_links=True).count() == 0

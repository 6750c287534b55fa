import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from checks.compare import compare, duck
from gridloom.llm import lexical as x
from gridloom.llm.queries import QUERIES, SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total = len(held), sum(size for *_, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, some in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in some if df[t]}
        scored = []
        for d, c, size in held:
            m = 10 + 90 * size * n // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in w if t in c)
            if score > 0:
                scored.append((-score, d is not None, d if d is not None else 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def found(spark, docs, items, k=10):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = x.search(x.build(df), spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def some_texts(n, seed, words=400, longest=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("text", ["", None, "A b-C_d", "É é ß straße", "x\x00y\x7fz", "日本 語,1.5", "ſ K ı İ", "a" * 10])
def test_terms(text):
    assert [t.decode() for t in x.terms(text)] == terms(text)


def test_search_against_brute_force(spark):
    docs = list(enumerate(some_texts(900, 1)))
    items = list(enumerate(some_texts(30, 2, longest=12)))
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_rows_that_hold_nothing_ties_and_repeats(spark):
    docs = [(None, "red apple"), (None, "red apple"), (7, "red apple"), (7, "red apple"), (3, "red apple"), (5, "Red, RED; apple"), (1, None), (2, ""), (4, " .,;"), (6, "pear " * 90000)]
    items = [(1, "red"), (1, "apple red"), (2, None), (3, ""), (None, "pear apple"), (4, "unknown words"), (5, "pear")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 2) == brute(docs, items, 2)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id long, text string, `shard` long, `term` long, `a.b` long")
    asked = spark.createDataFrame([(1, "a", 1, 2)], "item_id long, text string, `q` long, `x.y` long")
    assert x.search(x.build(none), asked).count() == 0
    assert x.search(x.build(some), asked.limit(0)).count() == 0
    out = x.search(x.build(some.union(some.selectExpr("doc_id + 1", "'c'", "shard", "term", "`a.b`"))), asked)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 1


def lists_of(docs):
    """Postings, norms and document frequencies of one shard, in this process."""
    shard = x.Shard()
    for d, t in docs:
        shard.add(d, t)
    first, *rest = shard.rows(0)
    n = first.column("df")[0].as_py()
    lengths = np.frombuffer(first.column("data")[0].as_py(), dtype=np.int64)[n:]
    m = x.norms(lengths, n, int(lengths.sum()))
    known = {r["term"]: (r["df"], x.Postings(r["heads"], r["data"], r["df"], n, int(lengths.sum()))) for batch in rest for r in batch.to_pylist()}
    return known, m, n


def test_blocks_hold_all_postings():
    docs = list(enumerate(some_texts(3000, 3)))
    docs[5] = (5, "w0 " * 70000)
    known, m, _ = lists_of(docs)
    held = [(i, Counter(terms(t))) for i, (_, t) in enumerate((d, t) for d, t in docs if t)]
    for term, (df, p) in known.items():
        want = [(i, c[term]) for i, c in held if term in c]
        assert df == len(want) == len(p.docs)
        p.open(np.arange(len(p.ready)), m)
        assert p.docs.tolist() == [i for i, _ in want]
        value = x.impacts(np.array([c for _, c in want]), m[[i for i, _ in want]])
        assert p.value.tolist() == value.tolist()
        assert p.most.tolist() == [value[b: b + x.BLOCK].max() for b in range(0, df, x.BLOCK)]


def test_blocks_that_cannot_matter_stay_closed():
    docs = list(enumerate(some_texts(20000, 4, longest=30)))
    docs += [(20000 + i, "rare word") for i in range(300)]
    known, m, n = lists_of(docs)
    asked = ["rare", "word", "w0", "w1", "w2", "w3"]
    lists = [(math.floor(1000 * math.log((2 * n + 2) / (2 * known[t][0] + 1))), known[t][1]) for t in asked]
    got = x.max_score(lists, m, 10)
    assert len(got[0]) == 10 and not known["w0"][1].ready.all()
    # All lists scored in full give the same.
    sums = np.zeros(len(m), dtype=np.int64)
    for w, p in lists:
        p.open(np.arange(len(p.ready)), m)
        sums[p.docs] += w * p.value
    order = np.lexsort((np.arange(len(m)), -sums))[:10]
    assert got[0].tolist() == order.tolist() and got[1].tolist() == sums[order].tolist()


def test_norms_beyond_64_bits():
    lengths = np.array([1, 10**9, 3 * 10**9], dtype=np.int64)
    n, total = 10**10, 10**13
    assert x.norms(lengths, n, total).tolist() == [10 + 90 * n * int(v) // total for v in lengths]


def test_several_shards(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(some_texts(600, 5))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = list(enumerate(some_texts(300, 6, longest=5)))  # more than one block of items
    index = x.build(df)
    assert index.shards.filter("term is null").count() == 7
    out = x.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in out) == brute(docs, items)


def test_query(spark, sf):
    assert compare(spark, duck(sf), QUERIES["op11_ranked_search"], SQL["op11_ranked_search"], sf) == ""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing

T = "doc_id long, text string, source string"


def brute_targets(size_by_source):
    names = sorted((s for s in size_by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in size_by_source)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size_by_source.values()), set()
    while True:
        left = sum(weight[s] for s in names if s not in capped)
        share = (total - sum(3 * size_by_source[s] for s in capped)) / left if left else 0
        more = {s for s in names if s not in capped and share * weight[s] >= 3 * size_by_source[s]}
        if not more:
            return {s: 3.0 * size_by_source[s] if s in capped else share * weight[s] for s in names}
        capped |= more


def words(n):
    return " ".join(["w"] * n)


@pytest.fixture
def docs(spark):
    rows = [(i, words(1 + i * 37 % 211), f"s{i % 7}" if i % 3 else "s0") for i in range(1500)]
    rows += [(2000 + i, words(5), None) for i in range(10)] + [(3000, None, "s1"), (3001, "", "s1"), (3002, " \t\n", "zz")]
    rows += [(4000, words(9), "s2")] * 400 + [(None, words(3), "s3")] * 5 + [(5000, words(30000), "s4")]
    return spark.createDataFrame(rows, T), rows


def test_targets_and_totals(spark, docs):
    df, rows = docs
    got = mixing.mix_sizes(df).collect()
    assert len(got) == len(rows)
    size, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        n = len((t or "").split())
        size[s] += n
        largest[s] = max(largest[s], n)
    target, taken = brute_targets(size), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len((t or "").split())) for i, t, _ in rows)


def test_reruns_agree_whatever_the_partitions(spark, docs):
    df, _ = docs
    one = sorted(map(str, mixing.mix_sizes(df).collect()))
    assert one == sorted(map(str, mixing.mix_sizes(df.repartition(5, F.rand(3))).collect()))


def test_expectation(spark):
    df = spark.createDataFrame([(i, words(1 + i % 4), "ab"[i % 2]) for i in range(600)], T)
    total = defaultdict(float)
    for seed in range(12):
        for r in mixing.mix_sizes(df, seed=seed).collect():
            total[(r.source, r.size)] += r.taken / r.target / 12 * r.source_size
    for (s, n), x in total.items():
        assert x == pytest.approx(sum(1 + i % 4 for i in range(600) if "ab"[i % 2] == s and 1 + i % 4 == n), rel=0.1)


def test_mix_repeats_rows_and_keeps_columns(spark, docs):
    df, _ = docs
    df = df.withColumns({"copies": F.lit("x"), "_k": F.lit(1)})
    out = mixing.mix(df)
    assert out.columns == df.columns
    want = {(r.doc_id, r.source, r.size): 0 for r in mixing.mix_sizes(df).collect()}
    for r in mixing.mix_sizes(df).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    got = {k: 0 for k in want}
    for r in out.collect():
        got[(r.doc_id, r.source, len((r.text or "").split()))] += 1
    assert got == want


def test_empty(spark):
    assert mixing.mix_sizes(spark.createDataFrame([], T)).count() == 0
    only = mixing.mix_sizes(spark.createDataFrame([(1, None, None), (2, "", "a")], T)).collect()
    assert [(r.taken, r.target) for r in only] == [(0, 0.0)] * 2

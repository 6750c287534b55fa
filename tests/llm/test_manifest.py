import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, duck
from gridloom.llm import manifest
from gridloom.llm.queries import QUERIES, SQL


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan=16):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i: i + fan])) for i in range(0, len(last), fan)])
    return levels


def path(levels, place, fan=16):
    out = []
    for level in levels[:-1]:
        start = place // fan * fan
        run = level[start: start + fan]
        out.append(("".join(run[: place - start]), "".join(run[place - start + 1:])))
        place //= fan
    return out


def brute(rows, columns, key, part):
    """{(part, place): (leaf, subroot, root, proof)} of rows as dictionaries."""
    parts = {}
    for r in rows:
        parts.setdefault(r[part], []).append((r[key] is not None, r[key], leaf([r[c] for c in columns])))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: climb([x[2] for x in sorted(parts[p], key=lambda x: (x[0], x[1] or 0, x[2]))]) for p in order}
    top = climb([trees[p][-1][0] for p in order])
    return {(k, i): (x, trees[p][-1][0], top[-1][0], path(trees[p], i) + path(top, k)) for k, p in enumerate(order) for i, x in enumerate(trees[p][0])}


def check(spark, df, columns, key="doc_id", part="source"):
    want = brute([r.asDict() for r in df.select(*{*columns, key, part}).collect()], columns, key, part)
    out = manifest.build(df, columns, key, part)
    got = out.prove(out.members).withColumn("folded", manifest.fold(F.col("proof"), F.col("leaf"))).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.leaf, r.subroot, out.root, [tuple(s) for s in r.proof]) == want[r.tree, r.place]
        assert r.folded == out.root
    return out


def test_small_parts_nulls_and_repeated_rows(spark):
    rows = [(None, "ä" * 3, None), (None, "", "s"), (1, "x", "s"), (1, "x", "s"), (1, "y", "s"), (2, None, None), (3, "long " * 30000, "é"), (5, "a", "z")]
    rows += [(k, f"t{k}", "many") for k in range(40)] + [(k, f"t{k}", "one over") for k in range(17)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source", "text"])


def test_parts_of_several_blocks(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 8500, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"))
    out = check(spark, df, ["doc_id", "source"])
    assert len(out.log) == 2  # the hot part's builders hand three roots on
    assert out.log[1].filter("level = 3").isEmpty()  # written once, by the lower builders


def test_log_is_a_postorder(spark):
    n = 4096 * 2 + 300
    leaves = spark.range(n).select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("n"), F.col("id").alias("place"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"))
    log = manifest.append_log(leaves)
    rows = sorted((r.pos, r.level, r.place) for t in log for r in t.collect())
    want, waiting = [], {}

    def write(level, place, last):
        want.append((len(want), level, place))
        waiting[level] = waiting.get(level, 0) + 1
        if (waiting[level] == 16 or last) and level < 4:
            waiting[level] = 0
            write(level + 1, place // 16, last)

    for i in range(n):
        write(0, i, i == n - 1)
    assert rows == want


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097, 70000])
def test_positions_number_all_nodes(n):
    levels = [n]
    while levels[-1] > 1:
        levels.append(-(-levels[-1] // 16))
    at = np.concatenate([manifest.position(k, np.arange(m), n) for k, m in enumerate(levels)])
    assert sorted(at.tolist()) == list(range(sum(levels)))


def test_some_claims_only(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    out = manifest.build(df, ["doc_id"], carry={"doc_id": F.col("doc_id"), "proof of": F.lit(1)})
    asked = out.members.filter("place in (0, 4095, 4999)").withColumn("proof.", F.lit("kept"))
    got = out.prove(asked.union(asked.filter("place = 0")).union(asked.filter("place = 0").withColumn("place", F.lit(6000).cast("long")))).collect()
    assert sorted(r.place for r in got) == [0, 0, 4095, 4999]
    assert all(r["proof."] == "kept" and r["proof of"] == 1 for r in got)


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([(k, k, k, k, "s") for k in range(3)], "`tree` long, `place` long, `a.b` long, doc_id long, source string")
    out = manifest.build(df, ["tree", "a.b"], key="place", carry={"tree_": F.col("tree"), "leaf of": F.col("`a.b`")})
    assert out.members.columns == ["tree", "place", "n", "leaf", "tree_", "leaf of"]
    none = manifest.build(df.limit(0), ["tree"])
    assert none.root is None and none.prove(none.members).count() == 0


def test_a_change_of_any_value_is_seen(spark):
    rows = [(k, f"T{k}", "s") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = manifest.build(df, ["doc_id", "text", "source"], carry={"doc_id": F.col("doc_id"), "claim": manifest.digest(["doc_id", F.lower("text"), "source"])})
    folded = out.prove(out.members.filter("place < 5")).withColumn("folded", manifest.fold(F.col("proof"), F.col("claim")))
    assert folded.filter(F.col("folded") == out.root).count() == 0


def test_query(spark, sf):
    assert compare(spark, duck(sf), QUERIES["op13_merkle_manifest"], SQL["op13_merkle_manifest"], sf) == ""
    for r in QUERIES["op13_merkle_manifest"](spark, sf).collect():
        assert r.verified or zlib.crc32(str(r.doc_id).encode()) % 5 == 0

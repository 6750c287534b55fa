"""Similarity join of texts by the Jaccard index of their word shingles; exact.

Texts with equal shingle sets are one class. Two classes can only be similar
enough when their sizes are, and when their rarest shingles (as many as a
similar partner could lack, plus one) have one in common. So a tile is a rare
shingle and a size band. In a tile, hashed bitmaps bound the overlap of two
classes from above by counting bits, and only pairs that pass meet as sorted
arrays. Pairs that would join what is joined already are never looked at,
unless all links are asked for; then each component is cut into pairs of blocks
of classes, and a block's tiles, bitmaps and arrays are held together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bloom_bits, bloom_build, bloom_test, bloom_test_numpy, components, lean, mix64, slices, stored
from gridloom.llm.shingles import set_hash, text_sets

#: Similar means: 100 * shared shingles >= PERCENT * all shingles of both.
PERCENT = 80
#: Counters of the sketch of shingle frequencies (4 bytes each) and the pieces it is added up in.
COUNTERS, PIECES = 1 << 20, 64
#: Bits of a bitmap signature per shingle, at least; the next power of two is taken.
BITS = 4
#: Rows of a tile up to which all its pairs are listed; in a larger one signatures come along and sort them out at once.
FEW = 64
#: Rows of a large tile that meet in one block; beyond, it is cut into pairs of blocks.
BLOCK = 2048
#: Shingles of a component's classes that meet in one block, about; beyond, it is cut into more blocks.
BLOCK_SHINGLES = 1 << 22

_PROFILE = "cls long, n long, signature binary, piece int, counts binary"


def _batches(it, column: str = "text"):
    for batch in it:
        yield batch, text_sets(batch.column(column))


def prefix_length(n: int) -> int:
    """Shingles of a set of ``n`` of which a similar set must hold one, whatever the order."""
    return n - -(-n * PERCENT // 100) + 1


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds class, set size and signature to each row; at the end rows with this task's part of the sketch."""
    counts = np.zeros(COUNTERS, dtype=np.uint32)
    for batch, sets in _batches(it):
        cls, n, bits = [], [], []
        for h in sets:
            n.append(len(h))
            cls.append(set_hash(h) if len(h) else None)
            bits.append(signature(h) if len(h) else None)
            np.add.at(counts, (h & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
            ["doc_id", "key", "cls", "n", "signature", "piece", "counts"])
    step = COUNTERS // PIECES
    if counts.any():
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(PIECES, pa.int64())] * 4, pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int32()),
             pa.array([counts[i * step: (i + 1) * step].tobytes() for i in range(PIECES)], pa.binary())],
            ["doc_id", "key", "cls", "n", "signature", "piece", "counts"])


def _add_up(table: pa.Table) -> pa.Table:
    total = None
    for c in table.column("counts"):
        part = np.frombuffer(c.as_buffer(), dtype=np.uint32)
        total = part.astype(np.uint64) if total is None else total + part
    total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
    return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(profile: DataFrame) -> np.ndarray:
    """How often each counter was met in the corpus: 4 MB, whatever the input; added up by piece, in two steps."""
    parts = profile.filter("piece is not null").select("piece", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    some = parts.groupBy("piece", "salt").applyInArrow(_add_up, "piece int, counts binary")
    got = some.groupBy("piece").applyInArrow(_add_up, "piece int, counts binary").collect()
    out = np.zeros(COUNTERS, dtype=np.uint32)
    step = COUNTERS // PIECES
    for r in got:
        out[r["piece"] * step: (r["piece"] + 1) * step] = np.frombuffer(r["counts"], dtype=np.uint32)
    return out


def signature(h: np.ndarray) -> bytes:
    """Bitmap with one bit for each shingle's hash, its width a power of two that follows the size of the set."""
    width = max(64, 1 << (BITS * len(h) - 1).bit_length())
    out = np.zeros(width, dtype=np.uint8)
    out[(mix64(h) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


class Signatures:
    """Signatures of rows by width. A bitmap folds to half its width by joining its halves, so sets of unlike sizes compare."""

    def __init__(self, rows: list[bytes]):
        words = np.array([len(r) // 8 for r in rows], dtype=np.int64)
        self.words, self.at = words, {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            matrix = np.frombuffer(b"".join(rows[i] for i in own.tolist()), dtype=np.uint64).reshape(-1, w)
            self._add(w, own, matrix)
        for w in sorted(self.at, reverse=True):
            own, matrix = np.flatnonzero(words == w), self.at[w][1]
            if w > 1:
                matrix = matrix[: len(own)]
                self._add(w // 2, own, matrix[:, : w // 2] | matrix[:, w // 2:])

    def _add(self, w: int, rows: np.ndarray, matrix: np.ndarray) -> None:
        place, held = self.at.get(w, (np.full(len(self.words), -1, dtype=np.int64), np.zeros((0, w), dtype=np.uint64)))
        place[rows] = len(held) + np.arange(len(rows))
        self.at[w] = (place, np.concatenate((held, matrix)))

    def bound(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Most shingles that the sets of rows ``a`` and ``b`` can share; their widths differ by a factor of 2 at the most.

        A bit that only one has stands for a shingle that only one has.
        """
        out = np.zeros(len(a), dtype=np.int64)
        width = np.minimum(self.words[a], self.words[b])
        for w in np.unique(width).tolist():
            place, matrix = self.at[w]
            which = np.flatnonzero(width == w)
            for s in range(0, len(which), max(1, (1 << 18) // w)):
                i = which[s: s + max(1, (1 << 18) // w)]
                x, y = matrix[place[a[i]]], matrix[place[b[i]]]
                alone = [np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))]
                out[i] = np.minimum(na[i] - alone[0], nb[i] - alone[1])
        return out


def _rare(sketch):
    """Postings: the rarest shingles of each class, a class once per task."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen = sketch.value, set()
        for _, sets in _batches(it):
            out, cls, size = [], [], []  # shingles in order of rarity, class, set size
            rows = 0
            for h in sets:
                if not len(h) or (c := set_hash(h)) in seen:
                    continue
                seen.add(c)
                k = prefix_length(len(h))
                order = np.argsort(freq[(h & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")[:k]  # ties by the shingle itself
                out.append(h[order])
                cls.append(c)
                size.append(len(h))
                rows += k
                if rows > 200_000:
                    yield _postings(out, cls, size)
                    out, cls, size, rows = [], [], [], 0
            if out:
                yield _postings(out, cls, size)

    return emit


def _postings(out, cls, size) -> pa.RecordBatch:
    each = np.array([len(o) for o in out])
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(out).view(np.int64)), *(pa.array(np.repeat(np.array(v, dtype=np.int64), each)) for v in (cls, size)), pa.array(place.astype(np.int32))],
        ["h", "cls", "n", "place"])


def _sets_of(data: bytes, bits: int, hashes: int):
    """Sorted sets of the classes that a Bloom filter holds, a class once per task."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _batches(it):
            cls, held, size = [], [], 0
            for h in sets:
                if not len(h) or (c := set_hash(h)) in seen:
                    continue
                if not bloom_test_numpy(np.array([c], dtype=np.int64).view(np.uint64), data, bits, hashes)[0]:
                    continue
                seen.add(c)
                cls.append(c)
                held.append(h)
                size += len(h)
                if size > 500_000:
                    yield _set_rows(cls, held)
                    cls, held, size = [], [], 0
            if cls:
                yield _set_rows(cls, held)

    return emit


def _set_rows(cls, held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cls, pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], ["cls", "shingles"])


def _enough(shared, na, nb):
    return 100 * shared >= PERCENT * (na + nb - shared)


def _exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that are similar: bitmaps first, then the sorted arrays."""
    for batch in it:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        keep = np.zeros(len(a), dtype=bool)
        left, right = batch.column("left"), batch.column("right")
        for i in range(len(a)):
            x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (left, right))
            if min(len(x), len(y)) * 100 < PERCENT * max(len(x), len(y)):
                continue
            at = np.searchsorted(y, x)
            shared = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
            keep[i] = _enough(shared, len(x), len(y))
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _bounded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bitmaps allow enough overlap."""
    for whole in it:
        for start, stop in slices(whole.column("na").to_numpy() + whole.column("nb").to_numpy()):
            batch = whole.slice(start, stop - start)
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            i = np.flatnonzero(100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
            if len(i):
                left, right = (batch.column(c).take(pa.array(i)).to_pylist() for c in ("left", "right"))
                k = np.arange(len(i))
                i = i[_enough(Signatures(left + right).bound(k, k + len(i), na[i], nb[i]), na[i], nb[i])]
            yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[i])], ["a", "b"])


def _likely(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) whose bitmaps allow enough overlap; only signatures that are asked for are shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    n = wanted.count()
    if not n:
        return pairs
    bits, hashes = bloom_bits(n, 0.01)
    asked = bloom_test(F.col("cls"), bloom_build(wanted, F.col("cls"), bits, hashes), bits, hashes)
    brief = profile.filter("n > 0").filter(asked).select("cls", "n", "signature").dropDuplicates(["cls"])
    both = pairs.join(brief.toDF("a", "na", "left"), "a").join(brief.toDF("b", "nb", "right"), "b")
    return both.mapInArrow(lean(_bounded), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) that are similar. Only texts that a Bloom filter of their classes lets pass are shuffled, as sorted arrays."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    n = wanted.count()
    if not n:
        return pairs
    bits, hashes = bloom_bits(n, 0.01)
    data = bloom_build(wanted, F.col("cls"), bits, hashes)
    sets = texts.mapInArrow(lean(_sets_of(data, bits, hashes)), "cls long, shingles binary")
    sets = stored(sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "ngram-sets")
    return pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").mapInArrow(lean(_exact), "a long, b long")


def _tiles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components within a tile that may be similar; rows come sorted by tile."""
    rest = None
    for batch in it:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        key = [table.column(c).to_numpy() for c in ("h", "i", "j")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        rest = table.slice(cut)
        if cut:
            yield from _pairs(table.slice(0, cut), np.concatenate(([0], new)))
    if rest is not None and rest.num_rows:
        yield from _pairs(rest, np.array([0, rest.num_rows]))


def _pairs(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    cls, n, place, comp, side = (table.column(c).to_numpy() for c in ("cls", "n", "place", "comp", "side"))
    signatures = Signatures(table.column("signature").to_pylist()) if "signature" in table.column_names else None

    def passed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        keep = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] == 2)) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))
        # If this is the rarest shingle that both have, they share no more than what follows it in either.
        keep &= _enough(np.minimum(n[a] - place[a], n[b] - place[b]), n[a], n[b])
        a, b = a[keep], b[keep]
        if signatures:
            keep = _enough(signatures.bound(a, b, n[a], n[b]), n[a], n[b])
            a, b = a[keep], b[keep]
        a, b = cls[a], cls[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    two = edges[:-1][np.diff(edges) == 2]
    if len(two):
        yield passed(two, two + 1)
    a, b, held = [], [], 0
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if e - s < 3:
            continue
        for x in range(s, e - 1):  # rows come by size, so similar ones follow at once
            y = np.arange(x + 1, x + 1 + np.searchsorted(n[x + 1: e], n[x] * 100 // PERCENT, side="right"))
            y = y[comp[y] != comp[x]]
            if len(y):
                a.append(np.full(len(y), x))
                b.append(y)
                held += len(y)
                if held > 50_000:
                    yield passed(np.concatenate(a), np.concatenate(b))
                    a, b, held = [], [], 0
    if held:
        yield passed(np.concatenate(a), np.concatenate(b))


def _mixed_tiles(tiles: DataFrame, comp: DataFrame, profile: DataFrame) -> DataFrame:
    """Candidate pairs that lie in different components, from tiles that hold more than one."""
    df = tiles.join(comp.toDF("cls", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    df = stored(df, "ngram-labelled")
    many = df.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).filter("lo <> hi")
    df = df.join(many.select("h", "rows"), "h")
    narrow = ["h", "i", "j", "cls", "n", "place", "comp", "side"]
    small = df.filter(F.col("rows") <= FEW).withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(2)}).select(*narrow)
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    # Block b meets every other block once, as (i, j) with i < j, and itself as (b, b).
    large = df.filter(F.col("rows") > FEW).withColumns({"blocks": blocks, "own": own}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")}).withColumn(
        "side", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("own") == F.col("j")).cast("int")))
    brief = profile.filter("n > 0").select("cls", "signature").dropDuplicates(["cls"])
    large = large.join(brief, "cls").select(*narrow, "signature")
    pairs = [part.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "cls").mapInArrow(lean(_tiles), "a long, b long") for part in (small, large)]
    return pairs[0].union(pairs[1]).distinct()


def _component_blocks(comp: DataFrame, profile: DataFrame, texts: DataFrame) -> DataFrame:
    """cls, side, rows (documents) and shingles of the classes of each component, in pairs of blocks; sorted by comp, i, j."""
    known = stored(profile.filter("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.count("*").alias("rows")).join(comp.toDF("cls", "comp"), "cls"), "ngram-members-of")
    n = known.count()
    bits, hashes = bloom_bits(n, 0.01)
    data = bloom_build(known, F.col("cls"), bits, hashes)
    sets = texts.mapInArrow(lean(_sets_of(data, bits, hashes)), "cls long, shingles binary")
    sets = stored(sets.join(known.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "ngram-sets-of")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    df = known.join(known.groupBy("comp").agg(blocks.alias("blocks")), "comp").withColumn("own", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    # Block b meets every other block once, as (i, j) with i < j, and itself as (b, b).
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")})
    df = df.withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("own") == F.col("j")).cast("int")))
    df = df.select("comp", "i", "j", "cls", "side", "rows").join(sets, "cls")
    return df.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "cls")


def _similar(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each block with the rows a < b of its similar pairs, in parts."""
    rest = None
    for batch in it:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        key = [table.column(c).to_numpy() for c in ("comp", "i", "j")]
        edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist()]
        for s, e in zip(edges, edges[1:]):
            yield from _similar_rows(table.slice(s, e - s))
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield from _similar_rows(rest)


def _similar_rows(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    m, side = table.num_rows, table.column("side").to_numpy()
    if m < 2 or side.min() == side.max() != 2:
        return
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("shingles")]
    n = np.array([len(h) for h in sets], dtype=np.int64)
    starts = np.cumsum(n) - n
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Tiles of the block: classes that have one of their rarest shingles in common, as rare as they are here.
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    who = np.repeat(np.arange(m), n)
    order = np.lexsort((rank[code], who))
    first = np.arange(len(order)) - np.repeat(starts, n) < np.repeat(n + -n * PERCENT // 100 + 1, n)
    order = order[first & (often[code[order]] > 1)]
    order = order[np.lexsort((who[order], code[order]))]
    edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, dtype=np.int64)
    may, seen = np.zeros((m, m), dtype=bool), set()
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        tile = who[order[s:e]]
        if e - s > 1 and (name := tile.tobytes()) not in seen:
            seen.add(name)
            may[np.ix_(tile, tile)] = True
    signatures = Signatures([signature(h) for h in sets])
    mark = np.zeros(len(often), dtype=bool)
    for x in range(m - 1):
        y = x + 1 + np.flatnonzero(may[x, x + 1:])
        y = y[((side[y] != side[x]) | (side[x] == 2)) & (100 * np.minimum(n[y], n[x]) >= PERCENT * np.maximum(n[y], n[x]))]
        if len(y):
            y = y[_enough(signatures.bound(np.full(len(y), x), y, np.full(len(y), n[x]), n[y]), n[x], n[y])]
        if not len(y):
            continue
        own = code[starts[x]: starts[x] + n[x]]
        mark[own] = True
        shared = np.array([np.count_nonzero(mark[code[starts[k]: starts[k] + n[k]]]) for k in y.tolist()])
        mark[own] = False
        y = y[_enough(shared, n[x], n[y])]
        if len(y):
            yield table, np.full(len(y), x), y


def _every_link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar pairs of classes."""
    for table, a, b in _similar(it):
        cls = table.column("cls").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], ["a", "b"])


def _links_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that each class of a block is linked to by its similar pairs there; one row per class and block."""
    held, linked = None, None

    def out() -> pa.RecordBatch:
        k = np.flatnonzero(linked)
        return pa.RecordBatch.from_arrays([pa.array(held.column("cls").to_numpy()[k]), pa.array(linked[k])], ["cls", "linked"])

    for table, a, b in _similar(it):
        if table is not held:
            if held is not None:
                yield out()
            held, linked, rows = table, np.zeros(table.num_rows, dtype=np.int64), table.column("rows").to_numpy()
        linked[a[0]] += rows[b].sum()
        linked[b] += rows[a[0]]
    if held is not None:
        yield out()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(profile, links): doc_id, key (hash of the text), cls, n per document; similar pairs (a, b) of classes that connect all that are connected.

    A class is a shingle set, named by its 64-bit hash; texts without words
    have n = 0 and no class. With ``every``, links are all similar pairs with
    a < b, of which a group of near copies has as many as its square.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    counted = stored(source.mapInArrow(lean(_count), f"doc_id long, key long, {_PROFILE}"), "ngram-profile")
    profile = counted.filter("n is not null").select("doc_id", "key", "cls", "n")
    sketch = spark.sparkContext.broadcast(_sketch(counted))  # COUNTERS * 4 bytes
    postings = source.select("text").mapInArrow(lean(_rare(sketch)), "h long, cls long, n long, place int")
    # A shingle of one class alone leads nowhere.
    w = F.expr("min(cls) over (partition by h) <> max(cls) over (partition by h)")
    tiles = stored(postings.withColumn("_many", w).filter("_many").select("h", "cls", "n", "place").distinct(), "ngram-tiles")
    # First each class against one of its tile and size band, then whatever is not joined by that. The centre of a tile is the
    # class with the fewest rarer shingles: an original has none of the shingles that only one of its copies has.
    known = tiles.withColumn("band", F.floor(F.log("n") / F.lit(-math.log(PERCENT / 100)) + 1e-9))
    star = known.groupBy("h", "band").agg(F.min(F.struct("place", "cls"))["cls"].alias("b"))
    first = known.select("h", "band", "cls").join(star, ["h", "band"]).filter("cls <> b").select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
    texts = source.select("text")
    likely = stored(_likely(stored(first, "ngram-star"), counted), "ngram-likely")
    links = stored(_verified(likely, texts), "ngram-first")
    more = _mixed_tiles(tiles, components(links, label="ngram-first"), counted)
    more = stored(more.join(likely, ["a", "b"], "left_anti"), "ngram-pairs")  # what failed once fails again
    more = stored(_likely(more, counted), "ngram-more")
    links = stored(links.union(_verified(more, texts)), "ngram-links")
    if not every:
        return profile, links
    blocks = _component_blocks(components(links, label="ngram-every"), profile, texts)
    return profile, blocks.mapInArrow(_every_link, "a long, b long")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that links reach, the document's own
    included. Null and empty texts and such without words have no shingles and
    link with nothing. Rows that repeat a doc_id stay rows of their own; a null
    doc_id joins like others and is never the smallest, unless it is alone.
    Other columns are not read. An empty table gives no rows. ``count_links``
    adds n_links, the number of other rows that are similar, those with the same
    text or set included; within components all pairs of different sets are met.
    """
    profile, links = classes(docs, doc_id, text)
    nodes = components(links, label="ngram")
    comp = nodes.toDF("cls", "comp")
    bare = profile.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    df = profile.filter("n > 0").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # Only components of more than one document need to be looked up.
    least = df.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_rows")).filter("_rows > 1").select("comp", "least")
    # As a written table of known size it is broadcast if small; else adaptive planning may split a hot component's documents.
    df = df.join(stored(least, "ngram-least"), "comp", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")]
    if not count_links:
        return df.select(*columns).union(bare.drop("n_links"))
    blocks = _component_blocks(nodes, profile, docs.select(F.col(text).alias("text")))
    linked = blocks.mapInArrow(_links_of, "cls long, linked long").groupBy("cls").agg(F.sum("linked").alias("linked"))
    same = profile.filter("n > 0").groupBy("cls").agg((F.count("*") - 1).alias("same")).filter("same > 0")
    df = df.join(linked, "cls", "left").join(same, "cls", "left")
    return df.select(*columns, (F.coalesce("linked", F.lit(0)) + F.coalesce("same", F.lit(0))).alias("n_links")).union(bare)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without their near copies: of each component one row stays, that with the smallest doc_id.

    Rows that share this id and their text are one more group of which one
    stays; null ids come last. Texts without words link with nothing and all
    stay. All columns are kept, whatever their names. Only rows that a Bloom
    filter takes for members of a group of two or more are shuffled.
    """
    profile, links = classes(docs, doc_id, text)
    comp = components(links, label="ngram").toDF("cls", "comp")
    known = profile.filter("n > 0").join(comp, "cls", "left").select("doc_id", "key", F.coalesce("comp", "cls").alias("comp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    groups = known.groupBy("comp").agg(first.alias("m"), F.count("*").alias("_rows")).filter("_rows > 1").select("comp", "m")
    chosen = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("key") == F.col("m.key"))
    members = known.join(groups, "comp").select("doc_id", "key", chosen.alias("chosen")).distinct()
    members = stored(members, "ngram-members")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"))
    n = members.count()
    if not n:
        return docs
    bits, hashes = bloom_bits(n, 0.001)
    h = F.xxhash64("doc_id", "key")
    held = bloom_test(h, bloom_build(members, h, bits, hashes), bits, hashes)
    m = members.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "chosen")
    met = rows.filter(held).join(m, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    one = met.filter("chosen").groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*")
    return rows.filter(~held).select("row.*").union(met.filter("chosen is null").select("row.*")).union(one)

"""Exact top-k search by inner product on a bit-sliced index.

Components are quantised to integers and stored by bit: for each attribute and
each bit one bitmap over the rows of a block. A query adds the slices of all
attributes, shifted by the bits of its own components, with bitmap adders; the
sum is bit-sliced too, so its best rows are found from the most significant
slice downward. What remains equal at the last slice is the boundary, settled
by the smaller id. Vectors whose sums could leave 64 bits meet the others as
Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.llm.vectors import matrix, usable

SCALE = 256
#: Rows of an index block and queries that search it together.
ROWS, QUERIES = 4096, 128
#: Added to a score, it gives a positive number of WIDTH hexadecimal digits, whatever doubles the vectors hold; these sort as text.
OFFSET, WIDTH = 1 << 2200, 551


def bound(dims: int) -> int:
    """Quantised components below this can be searched by slices: sums of ``dims`` products and their offsets fit 64 bits."""
    return math.isqrt((1 << 62) // (8 * max(dims, 1)))


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, w, largest) of usable vectors with an id: floor(SCALE * x) / SCALE as doubles, exact, and the largest of |w|."""
    v = F.col(vector)
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    x = lambda y: y.cast("double")
    w = F.transform("v", lambda y: F.when(F.abs(x(y)) < float(1 << 52), F.floor(x(y) * F.lit(float(SCALE))).cast("double") / F.lit(float(SCALE))).otherwise(x(y)))
    return df.select("vec_id", w.alias("w")).withColumn("largest", F.coalesce(F.array_max(F.transform("w", F.abs)), F.lit(0.0)))


def _narrow(dims: int) -> Column:
    return F.col("largest") < bound(dims) / SCALE


def _quantised(rows: DataFrame, dims: int) -> DataFrame:
    """Those of the usable rows that slices can hold, with q: SCALE * w as longs."""
    return rows.filter(_narrow(dims)).withColumn("q", F.transform("w", lambda y: (y * F.lit(float(SCALE))).cast("long"))).drop("w", "largest")


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) as little-endian bitmaps (..., words)."""
    pad = -bits.shape[-1] % 64
    bits = np.concatenate((bits, np.zeros((*bits.shape[:-1], pad), dtype=bool)), axis=-1) if pad else bits
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def slice_block(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, bits, slices) of integer rows: each attribute less its minimum, by bit, least significant first."""
    low = q.min(axis=0)
    up = q - low
    bits = np.array([int(x).bit_length() for x in up.max(axis=0)], dtype=np.int64)
    out = [pack(((up[:, d] >> b) & 1).astype(bool)) for d in range(q.shape[1]) for b in range(bits[d])]
    words = -(-len(q) // 64)
    return low, bits, np.array(out, dtype=np.uint64).reshape(int(bits.sum()), words)


def _index(dims: int):
    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in it:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            rows.append(matrix(batch.column("q"), dims).astype(np.int64))
            held += batch.num_rows
            while held >= ROWS:
                i, r = np.concatenate(ids), np.concatenate(rows)
                yield _index_row(i[:ROWS], r[:ROWS])
                ids, rows, held = [i[ROWS:]], [r[ROWS:]], held - ROWS
        if held:
            yield _index_row(np.concatenate(ids), np.concatenate(rows))

    return build


def _index_row(ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], q[order]
    low, bits, slices = slice_block(q)
    return pa.RecordBatch.from_arrays(
        [pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([q.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (low, bits, slices)]],
        ["ids", "dims", "low", "bits", "slices"])


def build_index(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int | None = None) -> DataFrame:
    """The stored index: one row per block of up to ROWS vectors, numbered. Every usable row with an id and components below ``bound`` is in it.

    Vectors are filled up to ``dims``, or to the longest.
    """
    rows = _usable(vectors, vec_id, vector)
    if dims is None:
        dims = rows.agg(F.max(F.size("w"))).first()[0] or 0
    out = _quantised(rows, dims).mapInArrow(_index(dims), "ids binary, dims int, low binary, bits binary, slices binary")
    return stored(out.select(F.monotonically_increasing_id().alias("block"), "*"), "topk-index")


def sums(low: np.ndarray, bits: np.ndarray, slices: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced scores (slice, query, word) of all queries against a block, and what each query's must be lessened by.

    A negative factor takes the complement of an attribute's slices instead, so
    that only non-negative numbers are added; the difference is one constant
    per query.
    """
    n, words = len(q), slices.shape[1]
    top = (np.int64(1) << bits) - 1  # largest value of each attribute, less its minimum
    size = int((np.abs(q) * top).sum(axis=1).max()) if n else 0
    total = np.zeros((max(size.bit_length(), 1) + 1, n, words), dtype=np.uint64)
    less = np.where(q < 0, np.abs(q) * top, 0).sum(axis=1) - (q * low).sum(axis=1)
    starts = np.cumsum(bits) - bits
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for d in range(len(bits)):
        if not bits[d]:
            continue
        factor = np.abs(q[:, d])
        flip = np.where(q[:, d] < 0, ones, np.uint64(0))[:, None]
        own = slices[starts[d]: starts[d] + bits[d]]
        for shift in range(int(factor.max()).bit_length()):
            users = np.flatnonzero((factor >> shift) & 1)
            if not len(users):
                continue
            part = total[:, users] if len(users) < n else total
            carry = np.zeros((len(users), words), dtype=np.uint64)
            turned = flip[users]
            for b in range(shift, len(total)):
                at = b - shift
                old = part[b]
                if at < bits[d]:
                    x = own[at][None, :] ^ turned
                    half = old ^ x
                    part[b], carry = half ^ carry, (old & x) | (half & carry)
                else:
                    if not carry.any():
                        break
                    part[b], carry = old ^ carry, old & carry
            if part is not total:
                total[:, users] = part
    return total, less


def best_rows(total: np.ndarray, exists: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the k largest of a bit-sliced number; of equals at the boundary, the first rows."""
    sure, open_ = np.zeros_like(exists), exists.copy()
    for slice_ in total[::-1]:
        more = sure | (open_ & slice_)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            open_ = open_ & slice_
        elif n < k:
            sure, open_ = more, open_ & ~slice_
        else:
            return more
    left = k - int(np.bitwise_count(sure).sum())
    boundary = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[:left]
    out = np.unpackbits(sure.view(np.uint8), bitorder="little")
    out[boundary] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _search(k: int, dims: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(batch.num_rows):
                get = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[r].as_buffer(), dtype=kind)  # noqa: E731, B023
                ids, bits, low = get("ids"), get("bits"), get("low")
                words = -(-len(ids) // 64)
                slices = get("slices", np.uint64).reshape(-1, words)
                queries, q = get("query_ids"), get("q").reshape(-1, dims)
                yield _block_best(get("numbers"), ids, low, bits, slices, queries, q, k, words)

    return run


def _block_best(numbers, ids, low, bits, slices, queries, q, k, words) -> pa.RecordBatch:
    total, less = sums(low, bits, slices, q)
    every = pack(np.ones((1, len(ids)), dtype=bool))[0]
    out_q, out_n, out_v, out_s = [], [], [], []
    weights = np.int64(1) << np.arange(len(total), dtype=np.int64)
    for i in range(len(queries)):
        exists = every
        lo, hi = np.searchsorted(ids, [queries[i], queries[i] + 1])
        if hi > lo:  # the query's own rows
            own = np.zeros(len(ids), dtype=bool)
            own[lo:hi] = True
            exists = every & ~pack(own[None, :])[0]
        rows = np.flatnonzero(np.unpackbits(best_rows(total[:, i], exists, k).view(np.uint8), bitorder="little"))
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        score = (((total[:, i, word] >> bit) & np.uint64(1)).astype(np.int64) * weights[:, None]).sum(axis=0) - less[i]
        out_q.append(np.full(len(rows), queries[i]))
        out_n.append(np.full(len(rows), numbers[i]))
        out_v.append(ids[rows])
        out_s.append(score)
    cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64))
    return pa.RecordBatch.from_arrays([cat(out_n), cat(out_q), cat(out_v), cat(out_s)], ["n", "query_id", "vec_id", "score"])


def _query_block(dims: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        q = matrix(rows.column("q").combine_chunks(), dims).astype(np.int64)
        numbers = rows.column("n").to_numpy()
        return pa.table({"part": rows.column("part")[:1], "numbers": pa.array([numbers.tobytes()], pa.binary()), "query_ids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([q.tobytes()], pa.binary())})

    return run


def integers(w: np.ndarray) -> np.ndarray:
    """SCALE * w as Python integers."""
    whole = lambda x: int(x) * SCALE if abs(x) >= 1 << 52 else int(x * SCALE)
    return np.array([[whole(x) for x in row] for row in w.tolist()], dtype=object).reshape(w.shape)


def _packed(dims: int, size: int):
    """Rows (n, vec_id, w) in blocks of up to ``size``: n, ids, w as bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                n, ids = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "vec_id"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (n, ids, matrix(part.column("w"), dims))], ["n", "ids", "w"])

    return run


def _search_wide(k: int, dims: int):
    """The k best rows of each block for each query of the other, as Python integers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(batch.num_rows):
                get = lambda c, kind=np.int64: np.frombuffer(batch.column(c)[r].as_buffer(), dtype=kind)  # noqa: E731, B023
                numbers, queries, ids = get("n"), get("query_ids"), get("ids")
                rows = integers(get("w", np.float64).reshape(len(ids), dims))
                out = []
                for n, q, a in zip(numbers.tolist(), queries.tolist(), integers(get("q", np.float64).reshape(len(queries), dims))):
                    best = sorted((-s, i) for s, i in zip((rows @ a).tolist() if dims else [0] * len(ids), ids.tolist()) if i != q)[:k]
                    out += [(n, q, i, f"{OFFSET - s:0{WIDTH}x}") for s, i in best]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([o[c] for o in out], pa.int64()) for c in range(3)), pa.array([o[3] for o in out], pa.string())], ["n", "query_id", "vec_id", "key"])

    return run


def _wide(asked: DataFrame, rows: DataFrame, k: int, dims: int) -> DataFrame:
    """(n, query_id, vec_id, key) of every block of ``asked`` with every block of ``rows``."""
    blocks = rows.select(F.lit(0).cast("long").alias("n"), "vec_id", "w").mapInArrow(_packed(dims, ROWS), "n binary, ids binary, w binary").select("ids", "w")
    parts = asked.select("n", "vec_id", "w").mapInArrow(_packed(dims, QUERIES), "n binary, ids binary, w binary").toDF("n", "query_ids", "q")
    met = blocks.crossJoin(parts).repartition(F.xxhash64("ids", "n"))
    return met.mapInArrow(_search_wide(k, dims), "n long, query_id long, vec_id long, key string")


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        keys = pa.array([f"{OFFSET + s:0{WIDTH}x}" for s in batch.column("score").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "query_id", "vec_id")), keys], ["n", "query_id", "vec_id", "key"])


def _scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        exact = [int(x, 16) - OFFSET for x in batch.column("key").to_pylist()]
        score = pa.array([x if -(1 << 63) <= x < 1 << 63 else None for x in exact], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "rank", "vec_id")), score, pa.array(list(map(str, exact)))], ["query_id", "rank", "vec_id", "score", "exact"])


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", exact: bool = False) -> DataFrame:
    """The k best rows of ``vectors`` for each query: query_id, rank (from 1), vec_id, score.

    Score: integer inner product of quantised vectors; ties to the smaller id;
    all rows, if fewer. Rows with the query's own id are not its candidates.
    Vectors that are null, hold null or non-finite components, or have no id
    take no part on either side. Vectors of unlike lengths are filled up with
    zeros. A query that is repeated with the same vector counts once; under one
    id with other vectors, each is answered for itself; a row that is repeated
    is a candidate as often. Other columns are not read; empty tables give no
    rows. Ranks are exact for any finite components; a score beyond 64 bits is
    null in ``score``, and ``exact`` adds a column of that name with all
    scores as decimal digits.

    Index blocks meet blocks of queries; each meeting hands on k rows per query.
    Vectors with components from ``bound`` on meet the other side in blocks of
    Python integers.
    """
    known, asked = _usable(vectors, vec_id, vector), _usable(queries, vec_id, vector)
    most = [df.agg(F.max(F.size("w")), F.max("largest")).first() for df in (known, asked)]
    dims = max(m[0] or 0 for m in most)
    limit = bound(dims) / SCALE
    index = build_index(vectors, vec_id, vector, dims)
    every = stored(asked.distinct().withColumn("n", F.monotonically_increasing_id()), "topk-asked")
    asked = _quantised(every, dims)
    parts, blocks = -(-asked.count() // QUERIES), index.count()
    part = F.pmod(F.xxhash64("vec_id", "q"), F.lit(max(parts, 1)))
    asked = asked.withColumn("part", part).groupBy("part").applyInArrow(_query_block(dims), "part long, numbers binary, query_ids binary, q binary")
    # One partition per index block, as far as that is sensible: the work is in the meetings, not in the bytes that adaptive planning sees.
    n = max(1, min(blocks, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    meet = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")) if parts else index.select("block", F.lit(0).alias("part")).limit(0)
    meet = meet.select("block", F.col("part").cast("long").alias("part")).join(asked, "part").repartition(n, "block")
    met = meet.join(index.repartition(n, "block"), "block").select(*[c for c in index.columns if c != "block"], "numbers", "query_ids", "q")
    found = met.mapInArrow(_search(k, dims), "n long, query_id long, vec_id long, score long")
    best = lambda df, by: df.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc(by), "vec_id"))).filter(F.col("rank") <= k)
    wide = [(m[1] or 0.0) >= limit for m in most]
    if any(wide):
        found = found.mapInArrow(_keys, "n long, query_id long, vec_id long, key string")
        if wide[0]:
            found = found.union(_wide(every.filter(_narrow(dims)), known.filter(~_narrow(dims)), k, dims))
        if wide[1]:
            found = found.union(_wide(every.filter(~_narrow(dims)), known, k, dims))
        out = best(found, "key").mapInArrow(_scores, "query_id long, rank int, vec_id long, score long, exact string")
        return out if exact else out.drop("exact")
    out = best(found, "score").select("query_id", "rank", "vec_id", "score")
    return out.withColumn("exact", F.col("score").cast("string")) if exact else out

"""Ranked lexical search: block-max postings in shards, read by MaxScore.

Each task turns the texts it reads into shards of bounded size: per term a list
of documents and counts, in compressed blocks. A block keeps the pairs of count
and length that no other pair of it beats, so its highest score is known for
any collection without looking into it. A query's terms are ordered by the
highest score of their lists. While the lowest of them together cannot reach
the threshold they are not essential: candidates come from the others only, and
a candidate meets a block of theirs only if the block's maximum could still
lift it. Shards hand on their best documents, which are merged.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.operators.ordered import number_rows

#: A shard is closed with so many documents or bytes of text.
SHARD_DOCS, SHARD_BYTES = 1 << 15, 1 << 24
#: Postings of a block, documents that are scored at once, and items that meet a shard together.
BLOCK, STEP, ITEMS = 128, 2048, 256
#: Stands for a null id inside an index.
NO_ID = -(1 << 63)

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_INDEX = "shard long, term string, df long, total long, heads binary, data binary"


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(_TABLE).split()


# ------------------------------------------------------------------- index


class Shard:
    """Postings of the documents of one shard as they come."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms(text)
        if not found:
            return
        times = Counter(found)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(len(found))
        self.terms.append(np.array(list(map(self.vocabulary.__getitem__, times)), dtype=np.int32))
        self.counts.append(np.array(list(times.values()), dtype=np.int32))
        self.bytes += len(text)

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.bytes >= SHARD_BYTES

    def rows(self, number: int, most: int = 50_000) -> Iterator[pa.RecordBatch]:
        """One row of ids and lengths, then one per term, ascending."""
        ids, lengths = np.array(self.ids, dtype=np.int64), np.array(self.lengths, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        ids, lengths = ids[order], lengths[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        yield _rows(number, [None], [len(ids)], int(lengths.sum()), [b""], [ids.tobytes() + lengths.tobytes()])
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term = rank[np.concatenate(self.terms)]
        doc = place[np.repeat(np.arange(len(ids)), [len(t) for t in self.terms])]
        tf = np.concatenate(self.counts).astype(np.int64)
        self.terms, self.counts = [], []
        order = np.argsort(term * len(ids) + doc)
        term, doc, tf = term[order], doc[order], tf[order]
        df = np.bincount(term, minlength=len(names))
        ends = np.cumsum(df)
        for a in range(0, len(names), most):
            b = min(a + most, len(names))
            lo, hi = int(ends[a] - df[a]), int(ends[b - 1])
            heads, data = encode(df[a:b], doc[lo:hi], tf[lo:hi], lengths[doc[lo:hi]])
            yield _rows(number, [t.decode() for t in names[a:b]], df[a:b], 0, heads, data)


def _rows(number: int, names: list, df, total: int, heads, data) -> pa.RecordBatch:
    n = len(names)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, number)), pa.array(names, pa.string()), pa.array(df, pa.int64()), pa.array(np.full(n, total)),
        pa.array(heads, pa.binary()), pa.array(data, pa.binary())], ["shard", "term", "df", "total", "heads", "data"])


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes that hold a number: 1, 2, 4 or 8."""
    return np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8)


def encode(df: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Heads and blocks of lists that stand one behind the other; ``df`` are their lengths.

    A head has, as 32-bit numbers (no text has as many terms): for each block its last document, its bytes
    and its number of pairs, then the pairs (count, length). A block has the
    bytes per gap and per count, the gaps between documents, the counts.
    """
    starts = np.cumsum(df) - df
    at = np.arange(len(doc)) - np.repeat(starts, df)
    blocks = -(-df // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    block = np.repeat(first_block, df) + at // BLOCK
    begin = np.flatnonzero(np.diff(block, prepend=-1))
    size = np.diff(np.append(begin, len(doc)))
    gap = np.diff(doc, prepend=-1)
    gap[starts] = doc[starts] + 1
    wide, deep = _width(np.maximum.reduceat(gap, begin)), _width(np.maximum.reduceat(tf, begin))
    room = 2 + size * (wide + deep)
    offset = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), dtype=np.uint8)
    out[offset], out[offset + 1] = wide, deep
    inner = at % BLOCK
    for values, width, base in ((gap, wide, offset + 2), (tf, deep, offset + 2 + size * wide)):
        w, cell = width[block], base[block] + inner * width[block]
        for k in range(int(width.max())):
            held = w > k
            out[cell[held] + k] = (values[held] >> 8 * k) & 255
    # Pairs that none beats: of a block by length, those with a higher count than all shorter documents.
    by = np.lexsort((-tf, length, block))
    top = block[by] * (int(tf.max()) + 1) + tf[by]
    best = np.maximum.accumulate(top)
    kept = np.r_[True, top[1:] > best[:-1]]
    pairs = np.stack([tf[by][kept], length[by][kept]], 1)
    n_pairs = np.bincount(block[by][kept], minlength=len(begin))
    info = np.stack([doc[begin + size - 1], room, n_pairs], 1)
    blob, info_blob, pair_blob = out.tobytes(), info.astype(np.int32).tobytes(), pairs.astype(np.int32).tobytes()
    pair_ends, ends = np.cumsum(n_pairs), offset + room
    heads, data = [], []
    for a, n in zip(first_block.tolist(), blocks.tolist()):
        b = a + n - 1
        heads.append(info_blob[12 * a: 12 * (b + 1)] + pair_blob[8 * int(pair_ends[a] - n_pairs[a]): 8 * int(pair_ends[b])])
        data.append(blob[int(offset[a]): int(ends[b])])
    return heads, data


def _index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, done, shard = TaskContext.get().partitionId() << 24, 0, Shard()
    for batch in it:
        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            for doc_id, text in zip(some.column("doc").to_pylist(), some.column("text").to_pylist()):
                shard.add(doc_id, text)
                if shard.full:
                    yield from shard.rows(part + done)
                    done, shard = done + 1, Shard()
    if shard.ids:
        yield from shard.rows(part + done)


@dataclass(frozen=True)
class Index:
    """Stored shards, and documents with a term and all their terms."""

    shards: DataFrame
    documents: int
    length: int


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of whole texts; every row with a term is a document, also if its id is null or repeated.

    Nothing is shuffled. Texts that are null or without terms are no documents.
    Other columns play no part.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    shards = stored(rows.mapInArrow(_index, _INDEX), "lexical-index")
    n, length = shards.filter("term is null").agg(F.sum("df"), F.sum("total")).first()
    return Index(shards, n or 0, length or 0)


# ------------------------------------------------------------------ search


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score, without its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The length term m of each document; whole numbers beyond 64 bits are taken one by one."""
    if 90 * n * int(lengths.max(initial=0)) < 1 << 63:
        return 10 + (90 * n * lengths) // total
    return np.array([10 + (90 * n * x) // total for x in lengths.tolist()], dtype=np.int64)


class Postings:
    """A term's list in a shard; blocks are decompressed when they are first asked for."""

    def __init__(self, heads: bytes, data: bytes, df: int, n: int, total: int):
        self.data = data
        numbers = np.frombuffer(heads, dtype=np.int32).astype(np.int64)
        blocks = -(-df // BLOCK)
        info, pairs = numbers[: 3 * blocks].reshape(-1, 3), numbers[3 * blocks:].reshape(-1, 2)
        self.last, room = info[:, 0], info[:, 1]
        self.begin = np.cumsum(room) - room
        firsts = np.cumsum(info[:, 2]) - info[:, 2]
        self.most = np.maximum.reduceat(impacts(pairs[:, 0], norms(pairs[:, 1], n, total)), firsts)
        self.top = int(self.most.max())
        # A closed block stands as its last document, so the whole is in order.
        self.docs, self.value = np.repeat(self.last, BLOCK)[:df], np.empty(df, dtype=np.int64)
        self.ready = np.zeros(blocks, dtype=bool)

    def open(self, blocks: np.ndarray, m: np.ndarray) -> None:
        """Decompress these blocks."""
        for b in blocks[~self.ready[blocks]].tolist():
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.docs))
            at = int(self.begin[b])
            wide, deep = self.data[at], self.data[at + 1]
            gaps = np.frombuffer(self.data, dtype=f"<u{wide}", count=hi - lo, offset=at + 2)
            tf = np.frombuffer(self.data, dtype=f"<u{deep}", count=hi - lo, offset=at + 2 + (hi - lo) * wide).astype(np.int64)
            self.docs[lo:hi] = (int(self.last[b - 1]) if b else -1) + np.cumsum(gaps.astype(np.int64))
            self.value[lo:hi] = impacts(tf, m[self.docs[lo:hi]])
            self.ready[b] = True

    def between(self, lo: int, hi: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``lo`` up to ``hi`` with their values."""
        a, b = int(np.searchsorted(self.last, lo)), min(int(np.searchsorted(self.last, hi - 1)) + 1, len(self.last))
        if a >= b:
            return self.docs[:0], self.value[:0]
        self.open(np.arange(a, b), m)
        docs = self.docs[a * BLOCK: b * BLOCK]
        x, y = np.searchsorted(docs, [lo, hi])
        return docs[x:y], self.value[a * BLOCK: b * BLOCK][x:y]


def max_score(lists: list[tuple[int, Postings]], m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of a shard with the highest scores above 0, and the scores; of equal scores the first."""
    lists = sorted((x for x in lists if x[0] * x[1].top > 0), key=lambda x: x[0] * x[1].top)
    bounds = np.cumsum([w * p.top for w, p in lists])
    docs, scores, least = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    for lo in range(0, len(m), STEP):
        hi = min(lo + STEP, len(m))
        idle = int(np.searchsorted(bounds, least, "right"))  # lists that together cannot beat the threshold
        if idle == len(lists):
            break
        sums = np.zeros(hi - lo, dtype=np.int64)
        for w, p in lists[idle:]:
            at, value = p.between(lo, hi, m)
            sums[at - lo] += w * value
        found = np.flatnonzero(sums)
        some, have = found + lo, sums[found]
        for j in range(idle - 1, -1, -1):
            alive = have + bounds[j] > least
            some, have = some[alive], have[alive]
            if not len(some):
                break
            w, p = lists[j]
            block = np.searchsorted(p.last, some)
            most = np.append(w * p.most, 0)[block]
            alive = have + most + (bounds[j - 1] if j else 0) > least
            some, have, block = some[alive], have[alive], block[alive]
            block = block[block < len(p.last)]  # the last candidates may lie behind the list
            if len(block):
                p.open(np.unique(block), m)
                head = some[: len(block)]
                at = np.searchsorted(p.docs, head)
                there = p.docs[at] == head
                have[: len(block)] += np.where(there, w * p.value[at], 0)
        better = have > least
        if better.any():
            docs, scores = np.concatenate([docs, some[better]]), np.concatenate([scores, have[better]])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(docs) == k:
                least = int(scores[-1])
    return docs, scores


def _item_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = [(q, t.decode()) for q, text in zip(batch.column("q").to_pylist(), batch.column("text").to_pylist()) for t in dict.fromkeys(terms(text))]
        q, t = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(t, pa.string())], ["q", "term"])


def _searcher(k: int, n: int, total: int):
    def search_shard(lists: pa.Table, tasks: pa.Table) -> pa.Table:
        task = tasks.to_pylist()[0] if tasks.num_rows else None
        found: list[tuple[int, int, int]] = []
        if task and lists.num_rows:
            size = task["size"]
            numbers = np.frombuffer(task["ids"], dtype=np.int64)
            ids, lengths = numbers[:size], numbers[size:]
            m = norms(lengths, n, total)
            known = {t: Postings(h, d, df, n, total) for t, h, d, df in zip(*(lists.column(c).to_pylist() for c in ("term", "heads", "data", "df")))}
            items: dict[int, list[tuple[int, Postings]]] = defaultdict(list)
            for x in task["asked"]:
                if x["term"] in known:
                    items[x["q"]].append((x["w"], known[x["term"]]))
            for q in sorted(items):
                docs, scores = max_score(items[q], m, k)
                found += zip([q] * len(docs), ids[docs].tolist(), scores.tolist())
        columns = list(zip(*found)) if found else [(), (), ()]
        shard = task["at"] if task else 0
        return pa.table([pa.array(c, pa.int64()) for c in columns] + [pa.array([shard] * len(found), pa.int64())], names=["q", "doc", "score", "shard"])

    return search_shard


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` best documents of each item by the sum over its different terms.

    Rows that repeat an item id are one item with the terms of all of them. An
    item without terms, or without a document above 0, gives no rows. Equal
    scores are ranked by id, null first. A term's weight follows from the
    documents that hold it; items meet each shard in blocks.
    """
    named = number_rows(items.select(F.col(f"`{item}`").alias("item")).distinct(), ["item"], "q")
    named = stored(named, "lexical-items")
    texts = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).alias("t")
    texts = texts.join(named.alias("n"), F.col("t.item").eqNullSafe(F.col("n.item"))).select("q", "text")
    asked = texts.mapInArrow(_item_terms, "q long, term string").distinct()
    asked = stored(asked.withColumn("part", F.shiftright("q", int(math.log2(ITEMS)))), "lexical-terms")
    lists = index.shards.filter("term is not null").select("shard", "term", "df", "heads", "data")
    met = stored(lists.join(asked.select("part", "term").distinct(), "term"), "lexical-lists")
    df = met.select("shard", "term", "df").distinct().groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    packs = asked.join(df.select("term", weight.cast("long").alias("w")), "term").groupBy("part").agg(F.collect_list(F.struct("q", "term", "w")).alias("asked"))
    heads = index.shards.filter("term is null").select("shard", F.col("df").alias("size"), F.col("data").alias("ids"))
    tasks = met.select("shard", "part").distinct().join(heads, "shard").join(packs, "part")
    tasks = tasks.select(F.col("shard").alias("at"), F.col("part").alias("of"), "size", "ids", "asked")
    got = met.groupBy("shard", "part").cogroup(tasks.groupBy("at", "of")).applyInArrow(
        _searcher(k, index.documents, index.length), "q long, doc long, score long, shard long")
    # Heaps are merged in two steps, so that one item's do not all reach one task.
    shards = index.shards.filter("term is null").count()
    got = _best(got.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(max(1, math.isqrt(shards))))), ["q", "group"], k).drop("rank")
    best = _best(got, ["q"], k)
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return best.join(named, "q").select(F.col("item").alias(item), "rank", doc.alias("doc_id"), "score")

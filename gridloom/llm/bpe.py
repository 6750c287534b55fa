"""Byte-level BPE: encoding and decoding of whole texts.

Texts are cut into pieces without regular expressions. Each code point gets a
symbol from its class and its neighbours; a small automaton over the symbols
says where pieces begin. The transition functions of blocks of symbols are
composed side by side, a scan carries the state from block to block, and a
second sweep marks the boundaries. Each piece is merged once and then read
from a cache; every token keeps its byte offset, which decoding uses.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from gridloom.llm.common import lean, mix64, slices

#: Most bytes of text that are encoded in one step; its arrays take about 40 times as many.
STEP_BYTES = 1 << 19

# ----------------------------------------------------------- code points

LETTER, NUMBER, OTHER, BLANK = range(4)
#: White space as Unicode's White_Space property has it (fixed values).
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: Endings that are cut off as pieces of their own: an apostrophe and these letters (fixed values of the pattern).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_ranges: list[list[int]] = []
_classes: dict[int, np.ndarray] = {}


def class_ranges() -> list[int]:
    """Where a run of code points of one class begins, and the class, in turn: as the tokenizer library's own Unicode version has them.

    Asked once, on the driver, so that all workers agree whatever their Python:
    with an encoding in which a letter, a digit or a full stop merges with any
    byte, the pair is one piece exactly if the library puts the code point into
    its class.
    """
    if not _ranges:
        import public_tokenizers
        import tiktoken

        heads = {LETTER: b"a", NUMBER: b"1", OTHER: b"."}
        ranks = {bytes([i]): i for i in range(256)}
        for head in heads.values():
            ranks |= {head + bytes([i]): len(ranks) + i for i in range(256)}
        ask = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c not in WHITE_SPACE]
        out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
        for kind, head in ((k, h) for k, h in heads.items() if k != OTHER):
            low = ranks[head + b"\0"]
            tokens = np.array(ask.encode_ordinary("".join([f"\n{head.decode()}{chr(c)}" for c in points])))
            firsts = tokens[np.flatnonzero(tokens[:-1] == 10) + 1]  # what follows each newline: the head, alone or merged
            out[np.array(points)[(firsts >= low) & (firsts < low + 256)]] = kind
        out[list(WHITE_SPACE)] = BLANK
        starts = np.flatnonzero(np.diff(out, prepend=255))
        _ranges.append(np.stack([starts, out[starts]], 1).ravel().tolist())
    return _ranges[0]


def code_point_classes(ranges: list[int] | None = None) -> np.ndarray:
    """Class of every code point."""
    ranges = class_ranges() if ranges is None else ranges
    key = hash(tuple(ranges))
    if key not in _classes:
        starts, kinds = np.array(ranges[::2]), np.array(ranges[1::2], dtype=np.uint8)
        _classes.clear()
        _classes[key] = np.repeat(kinds, np.diff(np.append(starts, sys.maxunicode + 1)))
    return _classes[key]


# ------------------------------------------------------------- automaton

# Symbols beyond the classes: a blank before other blanks or the end; a space before something else, which goes with it; another
# blank before something else; an apostrophe that begins an ending of one or two letters; the seam between two texts.
S_BLANK, S_JOIN, S_LAST, S_ONE, S_TWO, S_SEAM = 3, 4, 5, 6, 7, 8
# States: what the piece so far is. FRESH: whatever comes begins a piece.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, JOINED, TWO_LEFT, ONE_LEFT, FRESH = range(8)
_STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    move = np.zeros((9, _STATES), dtype=np.uint8)
    begins = np.ones((9, _STATES), dtype=bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (S_BLANK, IN_BLANKS)):
        move[symbol] = state
        begins[symbol, state] = False
    for symbol in (LETTER, NUMBER, OTHER, S_ONE, S_TWO):
        begins[symbol, JOINED] = False
    move[LETTER, TWO_LEFT], move[LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    move[S_JOIN], move[S_LAST], move[S_SEAM] = JOINED, FRESH, FRESH
    for symbol, state in ((S_ONE, ONE_LEFT), (S_TWO, TWO_LEFT)):
        move[symbol] = state
        move[symbol, [IN_OTHER, JOINED]] = IN_OTHER  # not at the start of a piece: a sign like others
        begins[symbol, IN_OTHER] = False
    return move, begins


def _functions(move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions of states that strings of symbols can have: values, number of each symbol's, number of each composition.

    Composition is associative, so blocks of text can be composed in any order;
    as there are few such functions, composing two is one table look-up.
    """
    known = {tuple(range(_STATES)): 0}
    todo = [tuple(range(_STATES))]
    symbols = [tuple(int(x) for x in row) for row in move]
    while todo:
        f = todo.pop()
        for g in symbols:
            both = tuple(g[x] for x in f)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    values = np.array(list(known), dtype=np.uint8)
    then = np.array([[known[tuple(int(g[x]) for x in f)] for g in values] for f in values], dtype=np.int32)
    return values, np.array([known[g] for g in symbols], dtype=np.int32), then


_MOVE, _BEGINS = _automaton()
_VALUES, _OF_SYMBOL, _THEN = _functions(_MOVE)
_MOVE_FLAT, _BEGINS_FLAT, _THEN_FLAT = _MOVE.ravel(), _BEGINS.ravel(), _THEN.ravel()
_COUNT = len(_VALUES)
#: Symbols per block of the scan.
_BLOCK = 64


def _symbols(points: np.ndarray, seams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of each code point; seams are positions between texts."""
    n = len(points)
    out = classes[points]
    out[seams] = OTHER
    blank = out == BLANK
    blank[seams] = False
    after = np.zeros(n, dtype=bool)  # something that is no blank follows in the same text
    after[:-1] = ~blank[1:]
    after[seams - 1] = False
    last = blank & after
    out[last] = S_LAST
    out[last & (points == 32)] = S_JOIN
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.concatenate((points, np.zeros(2, dtype=points.dtype)))
        one, two = padded[quotes + 1], padded[quotes + 2]
        for e in ENDINGS:
            hit = one == ord(e[0])
            if len(e) == 2:
                hit &= two == ord(e[1])
            out[quotes[hit]] = S_ONE if len(e) == 1 else S_TWO
    out[seams] = S_SEAM
    return out


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each symbol: functions of blocks are composed, states carried, boundaries marked."""
    n = len(symbols)
    blocks = -(-n // _BLOCK)
    rows = np.full(blocks * _BLOCK, S_SEAM, dtype=np.uint8)
    rows[:n] = symbols
    rows = np.ascontiguousarray(rows.reshape(blocks, _BLOCK).T)  # by position in the block
    total = _OF_SYMBOL[rows[0]]
    for row in rows[1:]:
        total = _THEN_FLAT[total * _COUNT + _OF_SYMBOL[row]]
    # An associative scan over the blocks: after the step of width w, each function is the composition of 2 w blocks.
    width = 1
    while width < blocks:
        total = np.concatenate((total[:width], _THEN_FLAT[total[:-width] * _COUNT + total[width:]]))
        width *= 2
    state = np.full(blocks, FRESH, dtype=np.uint8)
    state[1:] = _VALUES[total[:-1], FRESH]
    out = np.empty((_BLOCK, blocks), dtype=bool)
    for i, row in enumerate(rows):
        at = row * np.uint8(_STATES) + state
        out[i] = _BEGINS_FLAT[at]
        state = _MOVE_FLAT[at]
    return out.T.ravel()[:n]


def piece_bounds(texts: list[str], classes: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, byte offsets at which pieces begin (and the end), pieces per text."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seams = np.cumsum(n + 1) - 1
    begins = _scan(_symbols(points, seams, code_point_classes() if classes is None else classes))
    begins[seams] = False
    inside = np.ones(len(points), dtype=bool)
    inside[seams] = False
    wide = (1 + (points > 0x7F) + (points > 0x7FF).astype(np.uint8) + (points > 0xFFFF)).astype(np.int64)
    wide[seams] = 0
    at = np.cumsum(wide) - wide
    per_text = np.add.reduceat(begins, np.concatenate(([0], seams[:-1] + 1)), dtype=np.int64) if len(texts) else n
    data = "".join(texts).encode("utf-8", "surrogatepass")
    return data, np.append(at[begins], len(data)), per_text


# ------------------------------------------------------------------ merges

#: Of a little-endian word, the first k bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder(dict):
    """Cache from a piece to its token ids; a piece that is missing is merged first. Holds ``most`` pieces at a time."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000, ranges: list[int] | None = None):
        super().__init__()
        self.ranks, self.most, self.classes = ranks, most, code_point_classes(ranges)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.decimal = [b"%d" % i for i in range(len(self.tokens))]

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        whole = self.ranks.get(piece)
        ids = (whole,) if whole is not None else self._merge(piece) if len(piece) < 64 else self._merge_long(piece)
        if len(piece) < 256:
            self[piece] = ids
        return ids

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges the pair of lowest rank, the first of equals, until none is left."""
        ranks = self.ranks
        parts = [piece[i: i + 1] for i in range(len(piece))]
        none = len(self.tokens) + 1
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs over linked parts: n log n for very long pieces."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]; 0: swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i: i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i: end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h: stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i: end[i]]])
            i = end[i]
        return tuple(out)

    def _found(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces behind each other and ids per piece. Each distinct piece of up to 15 bytes is looked up once."""
        size = np.diff(bounds)
        padded = np.frombuffer(data + bytes(16), dtype=np.uint8)
        words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 9,), strides=(1,))
        short = np.flatnonzero(size <= 15)
        at, n = bounds[:-1][short], size[short]
        low = words[at] & _MASK[np.minimum(n, 8)]
        high = words[at + 8] & _MASK[np.maximum(n - 8, 0)]
        key = mix64(mix64(high + (n.astype(np.uint64) << np.uint64(58))) + low)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        same = first[which]
        if not ((low == low[same]) & (high == high[same]) & (n == n[same])).all():  # two pieces with one key: look up each
            first, which = np.arange(len(short)), np.arange(len(short))
        long_ = np.flatnonzero(size > 15)
        place = np.empty(len(size), dtype=np.int64)
        place[short] = which
        place[long_] = len(first) + np.arange(len(long_))
        begin = np.concatenate((at[first], bounds[long_]))
        end = np.concatenate((at[first] + n[first], bounds[long_ + 1]))
        found = [self[data[a:b]] for a, b in zip(begin.tolist(), end.tolist())]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(counts.sum()))
        starts = np.cumsum(counts) - counts
        sizes = counts[place]
        base = starts[place] - (np.cumsum(sizes) - sizes)
        return flat[np.repeat(base, sizes) + np.arange(int(sizes.sum()))], sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, each id's byte offset in its text, ids per text."""
        data, bounds, per_text = piece_bounds(texts, self.classes)
        ids, sizes = self._found(data, bounds)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        pieces = np.concatenate(([0], np.cumsum(per_text)))
        counts = np.diff(ends[pieces])
        wide = self.lengths[ids]
        places = np.cumsum(wide) - wide
        return ids, places - np.repeat(bounds[pieces[:-1]], counts), counts

    def decode(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts behind each other and bytes per text; every token is put at its offset."""
        wide = self.lengths[ids]
        ends = np.cumsum(counts)
        sizes = np.zeros(len(counts), dtype=np.int64)
        full = counts > 0
        sizes[full] = (offsets + wide)[ends[full] - 1]
        base = np.repeat(np.cumsum(sizes) - sizes, counts) + offsets
        out = np.zeros(int(sizes.sum()), dtype=np.uint8)
        source = self.starts[ids]
        k = 0
        while len(wide):
            out[base + k] = self.bytes[source + k]
            k += 1
            more = np.flatnonzero(wide > k)
            wide, base, source = wide[more], base[more], source[more]
        return out, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, ranges: list[int] | None = None) -> Encoder:
    """The worker's encoder for a file of ranks, made once; the file must be on every worker. Tasks end by clearing its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path), ranges=ranges)
    return _ENCODERS[path]


# --------------------------------------------------------------- operators

def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of a batch in runs of limited text."""
    texts = batch.column(column)
    sizes = np.array([n or 0 for n in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64)
    for a, b in slices(sizes, STEP_BYTES):
        yield a, b, [t or "" for t in texts.slice(a, b - a).to_pylist()]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """doc_id, ids, offsets: token ids of each whole text and the byte at which each begins.

    ``check`` decodes every text from its ids and offsets again; other bytes
    than those of the text end the run with an error.

    One row per input row, repeated rows too. Null and empty texts have no ids.
    Other columns are not read, whatever their names; an empty table gives no
    rows. ``path`` names a file of ranks that every worker can read.
    """

    ranges = class_ranges()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, ranges)
        for batch in it:
            for a, b, texts in _runs(batch, "text"):
                ids, offsets, counts = e.encode(texts)
                if check:
                    data, sizes = e.decode(ids, offsets, counts)
                    whole = [t.encode() for t in texts]
                    if data.tobytes() != b"".join(whole) or sizes.tolist() != list(map(len, whole)):
                        raise ValueError(f"texts do not decode to themselves, among doc_id {batch.column('doc_id').slice(a, b - a).to_pylist()[:100]}")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), _lists(ids, counts), _lists(offsets, counts)], ["doc_id", "ids", "offsets"])
        e.clear()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(lean(run), f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, content: the bytes of (doc_id, ids, offsets); null ids give null."""

    ranges = class_ranges()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, ranges)
        for batch in it:
            known = batch.column("ids").is_valid().to_pylist()
            ids, offsets = batch.column("ids").fill_null([]), batch.column("offsets").fill_null([])
            counts = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            data, sizes = e.decode(ids.flatten().to_numpy(), offsets.flatten().to_numpy().astype(np.int64), counts)
            data, ends = data.tobytes(), np.cumsum(sizes).tolist()
            out = [data[b - n: b] if k else None for b, n, k in zip(ends, sizes.tolist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids", "offsets").mapInArrow(lean(run), f"doc_id {kind}, content binary")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes the ids and digests both.

    The same steps as ``encode`` and ``decode`` on each batch, so that the ids
    of a large corpus need not be kept.
    """
    import hashlib

    ranges = class_ranges()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, ranges)
        name = e.decimal.__getitem__
        for batch in it:
            for a, b, texts in _runs(batch, "text"):
                ids, offsets, counts = e.encode(texts)
                data, sizes = e.decode(ids, offsets, counts)
                data, flat = memoryview(data.tobytes()), ids.tolist()
                ends, stops = np.cumsum(counts).tolist(), np.cumsum(sizes).tolist()
                of_ids = [hashlib.sha256(b",".join(map(name, flat[s - n: s]))).hexdigest() for s, n in zip(ends, counts.tolist())]
                of_text = [hashlib.sha256(data[s - n: s]).hexdigest() for s, n in zip(stops, sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts), pa.array(of_ids), pa.array(of_text)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.clear()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Quality of texts by line: a linear-chain conditional random field marks content and boilerplate.

Each line with a word is described by a few binned properties that hold in any
language. The field weighs them and the change from one line to the next; its
most probable labelling (Viterbi) gives the share of words in content lines,
and that share decides whether a text is kept. Weights are learned from labels
of whole texts: all lines of a good text are content, those of a bad one
boilerplate; a second fit lets lines of bad texts be content where the first
one says so. Simple counts of a text come along as base rules.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.llm.toxicity import training_rows

#: Labelled texts that the field is fitted on, at the most (a documented bound).
SAMPLE = 10_000
#: Content lines hold at least this share of the words of a text that is kept.
CONTENT = 0.5
#: Base rules: fewer words fail, and so does a larger share (in percent) of words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATS, WINDOW = 10, 20, 5
#: Evaluations of the likelihood per fit, and the ridge.
STEPS, RIDGE = 25, 1.0

SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_INNER = bytes(range(128, 192))
_SIGNS = bytes(c for c in range(33, 128) if c not in _LETTERS + _DIGITS)
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")
_LINKS = (b"http", b"www.", b"@", b"{", b"</")

#: Upper bounds of the bins of each property; one more bin lies above the last.
BINS: dict[str, tuple[float, ...]] = {
    "words": (2, 5, 10, 30),
    "word length": (3, 8, 12),
    "symbols a character": (0, 0.01, 0.05),
    "words without letters or digits": (0, 0.05, 0.2),
    "capitals among letters": (0.15, 0.4, 0.7),
    "digits a character": (0, 0.05, 0.2),
    "exclamation marks a word": (0, 0.2),
    "words like the one before": (0, 0.1, 0.4),
    "different words": (0.3, 0.6, 0.9),
    "sentence marks a word": (0, 0.02, 0.4),
    "ends like a sentence": (0,),
    "seen before": (0,),
    "links or markup": (0,),
}
_SIZES = [len(b) + 1 for b in BINS.values()]
_STARTS = np.cumsum([0, *_SIZES])
_FIRST, _BOUNDS = _STARTS.tolist(), list(BINS.values())
#: Weights: one per bin, for content; then the changes content to content, to boilerplate, and the other two.
WEIGHTS = int(_STARTS[-1]) + 4


def _count(line: bytes, some: bytes) -> int:
    return len(line) - len(line.translate(None, some))


def properties(line: bytes, words: list[bytes], seen: bool) -> bytes:
    """Bins of a line, numbered over all properties; ``words`` are those of the line."""
    n, size = len(words), len(line) - _count(line, _INNER)
    letters = _count(line, _LETTERS)
    bare = n - len(line.translate(None, _SIGNS).split())
    values = (
        n, (size - n + 1) / n, _count(line, SYMBOLS) / size, bare / n, _count(line, _UPPER) / letters if letters else 0.0,
        _count(line, _DIGITS) / size, line.count(b"!") / n, sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
        _count(line, b".!?") / n, not words[-1].endswith(_ENDS), seen, any(x in line for x in _LINKS),
    )
    return bytes([start + bisect_left(b, v) for start, v, b in zip(_FIRST, values, _BOUNDS)])


@dataclass(frozen=True)
class Counts:
    """Base counts of a text."""

    words: int
    word_chars: int
    symbols: int
    dup_lines: int
    repeat_words: int

    @property
    def failed(self) -> bool:
        return self.words < LEAST_WORDS or 100 * self.repeat_words > MOST_REPEATS * self.words


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.array(list(map(known.__getitem__, words)), dtype=np.int64)
    if len(known) == len(words):
        return 0
    windows, n, below = ids, len(known), len(known)
    for k in range(1, WINDOW):  # a window's number: that of its beginning and its last word, numbered anew where it grows too large
        if below * n >= 1 << 62:
            found, windows = np.unique(windows, return_inverse=True)
            below = len(found)
        windows, below = windows[:-1] * n + ids[k:], below * n
    _, windows, times = np.unique(windows, return_inverse=True, return_counts=True)
    often = times[windows] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(often), 1)
    np.add.at(cover, np.flatnonzero(often) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def read(text: str | None) -> tuple[Counts, list[bytes], list[int], list[int]]:
    """Counts of a text, and of each line with a word its properties, its number of words and its place (from 0)."""
    data = (text or "").encode()
    seen: set[bytes] = set()
    lines, sizes, places, words, dups = [], [], [], [], 0
    for place, line in enumerate(data.split(b"\n")):
        found = line.split()
        if not found:
            continue
        again = line in seen
        dups += again
        seen.add(line)
        lines.append(properties(line, found, again))
        sizes.append(len(found))
        places.append(place)
        words += found
    chars = len(data) - _count(data, _INNER) - _count(data, _BLANKS)
    return Counts(len(words), chars, _count(data, SYMBOLS), dups, repeated_words(words)), lines, sizes, places


def viterbi(lines: list[bytes], weights: list[float]) -> list[bool]:
    """The most probable labels, content or not; of equally probable ones content wins."""
    stay, leave, enter, out = weights[-4:]
    yes, no = 0.0, 0.0
    back: list[tuple[bool, bool]] = []
    for i, line in enumerate(lines):
        e = sum([weights[b] for b in line])
        if not i:
            yes = e
            continue
        back.append((yes + stay >= no + enter, yes + leave >= no + out))
        yes, no = e + max(yes + stay, no + enter), max(yes + leave, no + out)
    if not lines:
        return []
    labels = [yes >= no]
    for from_yes, from_no in reversed(back):
        labels.append(from_yes if labels[-1] else from_no)
    return labels[::-1]


class Sequences:
    """Texts as sequences of lines, the longest first, for sums over all labellings."""

    def __init__(self, texts: list[bytes], good: list[int]):
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        k = len(BINS)
        self.bins = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8).reshape(-1, k).astype(np.int64)
        self.length = np.array([len(texts[i]) // k for i in order], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.good = np.repeat(np.array([good[i] for i in order], dtype=bool), self.length)

    def steps(self) -> Iterator[np.ndarray]:
        """Numbers of the lines at place 1, 2, ... of their texts."""
        for t in range(1, int(self.length.max(initial=0))):
            yield self.first[: int(np.searchsorted(-self.length, -t, "left"))] + t

    def sums(self, w: np.ndarray, teacher: np.ndarray | None) -> np.ndarray:
        """Log-likelihood of the labels and its gradient."""
        p, before, after, z, e, move = self.posterior(w)
        y = self.good if teacher is None else self.good | (self.posterior(teacher)[0][:, 0] > 0.5)
        label = np.where(y, 0, 1)
        gradient = np.zeros(WEIGHTS)
        np.add.at(gradient, self.bins.ravel(), np.repeat(y - p[:, 0], len(BINS)))
        value = e[y].sum() - z[self.first].sum()
        for at in self.steps():
            joint = np.exp(before[at - 1][:, :, None] + move + (after[at] + np.stack([e[at], np.zeros(len(at))], 1))[:, None, :] - z[at][:, None, None])
            seen = np.bincount(2 * label[at - 1] + label[at], minlength=4)
            gradient[-4:] += seen - joint.sum(axis=0).ravel()
            value += seen @ move.ravel()
        return np.concatenate([[value], gradient])

    def posterior(self, w: np.ndarray) -> tuple:
        """Of each line the chances of both labels, sums of beginnings and of endings, the text's total, the line's weight."""
        e, move = w[self.bins].sum(axis=1), w[-4:].reshape(2, 2)
        before = np.zeros((len(e), 2))
        before[:, 0] = e
        after = np.zeros((len(e), 2))
        for at in self.steps():
            before[at] = np.logaddexp.reduce(before[at - 1][:, :, None] + move, axis=1)
            before[at, 0] += e[at]
        for at in reversed(list(self.steps())):
            own = after[at].copy()
            own[:, 0] += e[at]
            after[at - 1] = np.logaddexp.reduce(move + own[:, None, :], axis=2)
        total = np.logaddexp.reduce(before + after, axis=1)
        return np.exp(before + after - total[:, None]), before, after, total, e, move


def maximise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, kept: int = 8) -> np.ndarray:
    """Quasi-Newton ascent of a concave function with limited memory and backtracking, in about ``steps`` evaluations."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    done = 1
    while done < steps and np.abs(g).max() > 1e-3:
        d, a = g.copy(), []
        for s, y in reversed(pairs):
            a.append((s @ d) / (s @ y))
            d -= a[-1] * y
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).sum())
        for (s, y), c in zip(pairs, reversed(a)):
            d += s * (c - (y @ d) / (s @ y))
        rate = 1.0
        while True:
            new, h = f(x + rate * d)
            done += 1
            if new >= value + 1e-4 * rate * (g @ d) or done >= steps:
                break
            rate /= 3
        if new <= value:
            break
        s, y = rate * d, g - h
        if s @ y > 1e-10:
            pairs = [*pairs, (s, y)][-kept:]
        x, value, g = x + s, new, h
    return x


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            lines = [b"".join(read(t)[1]) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), part.column("good")], ["lines", "good"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", good: str = "quality", sample: int = SAMPLE) -> tuple[float, ...]:
    """Weights of the field from labelled texts that are not held out, at most ``sample``.

    Each evaluation is a Spark job over the sample's bins that adds up one
    gradient per task. Without labels of both kinds all lines are content, or
    boilerplate if all labelled texts are bad.
    """
    rows = training_rows(docs, labels, doc_id, text, good, sample).select("text", F.col("toxic").alias("good"))
    rows = rows.filter(F.col("good").isNotNull()).repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism))
    rows = stored(rows.mapInArrow(_features, "lines binary, good int").filter(F.length("lines") > 0), "quality-lines")
    n, n_good = rows.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n_good or n == n_good:
        return (*[-1.0 if n and not n_good else 1.0] * (WEIGHTS - 4), 0.0, 0.0, 0.0, 0.0)
    teacher: np.ndarray | None = None

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        taught = teacher

        def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                got = Sequences(batch.column("lines").to_pylist(), batch.column("good").to_pylist()).sums(w, taught)
                yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64()))], ["sums"])

        got = np.sum(sorted(r["sums"] for r in rows.mapInArrow(sums, "sums array<double>").collect()), axis=0)
        return got[0] - RIDGE / 2 * (w @ w), got[1:] - RIDGE * w

    w = maximise(evaluate, np.zeros(WEIGHTS), STEPS)
    teacher = w
    return tuple(np.round(maximise(evaluate, w, STEPS), 6).tolist())


_OUT = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("content", pa.float64()), ("kept", pa.bool_()), ("boilerplate", pa.list_(pa.int32()))])


def judge(docs: DataFrame, weights: tuple[float, ...], text: str = "text", out: str = "quality", share: float = CONTENT) -> DataFrame:
    """Adds ``out``: struct of the base counts, base_failed, content (share of words), kept and boilerplate (line numbers from 0).

    Whole texts are read. Null and empty texts have no words and fail the base
    rules; their content is 0. Equal texts get equal results, whatever else the
    rows hold. All other columns stay; ``out`` replaces a column of that name.
    """
    w = list(weights)

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                 "base_failed boolean, content double, kept boolean, boilerplate array<int>")
    def judged(texts: pa.Array) -> pa.Array:
        rows = []
        for start in range(0, len(texts), 256):  # few texts at a time as Python strings
            for t in texts.slice(start, 256).to_pylist():
                c, lines, sizes, places = read(t)
                labels = viterbi(lines, w)
                content = sum(n for n, y in zip(sizes, labels) if y) / c.words if c.words else 0.0
                rows.append((c.words, c.word_chars, c.symbols, c.dup_lines, c.repeat_words, c.failed, content,
                             not c.failed and content >= share, [p for p, y in zip(places, labels) if not y]))
        columns = zip(*rows) if rows else [[]] * len(_OUT)
        return pa.StructArray.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, _OUT)], fields=list(_OUT))

    return docs.withColumn(out, judged(F.col(f"`{text}`")))

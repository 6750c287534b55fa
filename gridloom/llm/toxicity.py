"""Toxicity scores from a learned lexicon, misspellings included.

The lexicon holds words and stems that labelled toxic texts have far more often
than others. Its trie is intersected with Levenshtein automata: a state is the
set of trie nodes that a word's beginning can stand for with so many edits, so
one walk compares a word with the whole lexicon. Each hit is then judged by its
window of words: quotation marks and reporting verbs speak for quotation,
direct address against it. A logistic regression turns the sums into a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import hand_back, lean, stored

#: Labelled texts that the model is fitted on, at the most (a documented bound); they bound the lexicon, too.
SAMPLE = 20_000
#: Lengths of stems; continuations that make a stem worth more than its words.
STEM_LENGTHS, CONTINUATIONS = range(3, 9), 3
#: An entry is at least so many times as frequent in toxic texts.
LIFT = 10.0
#: Words to each side of a hit that tell how it is meant.
WINDOW = 8
#: Words that report speech, and words that address somebody (English, French, German, Spanish).
REPORTING = frozenset("said says called wrote writes quote quoted quoting reported dit écrit appelé cité sagte schrieb nannte zitat dijo escribió llamó cita".split())
ADDRESS = frozenset("you your youre ya u tu toi vous te ton du dich dein ihr usted tú vosotros".split())

_WORD = re.compile(r"\w+")
#: Signs that stand for letters inside a word.
SIGNS = "*!@$#%€£+|"
_TOKEN = re.compile(rf"\w+(?:[{re.escape(SIGNS)}]+\w+)*")
_RUN = re.compile(r"(.)\1+")
_MARK = re.compile(r'[“”«»„"]|\n[ \t\r]*\n')


def edits_for(length: int) -> int:
    """Edits that still make a misspelling of a word of this length."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Deterministic automaton of a lexicon's trie and the Levenshtein automata of its entries, made as it is walked.

    With ``swaps`` two neighbouring letters in the wrong order are one edit, not two.
    """

    def __init__(self, words: list[str], stems: list[str], swaps: bool = False):
        self.swaps = swaps
        self.children: list[dict[str, int]] = [{}]
        self.word_edits: dict[int, int] = {}
        self.stem_edits: dict[int, int] = {}
        for entries, ends in ((words, self.word_edits), (stems, self.stem_edits)):
            for entry in entries:
                node = 0
                for c in entry:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                ends[node] = edits_for(len(entry))
        self.most = [0] * len(self.children)  # edits of the most lenient entry below
        for node in reversed(range(len(self.children))):
            below = [self.most[x] for x in self.children[node].values()]
            self.most[node] = max([*below, self.word_edits.get(node, 0), self.stem_edits.get(node, 0)])
        self.letters = {c for x in self.children for c in x}
        self.forget()

    def forget(self) -> None:
        """Drops all states; they are made again as they are needed."""
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[int | None] = []
        self.states: list[tuple] = []
        self.dead = self._number({}, {}, None)
        self.start = self._number({0: 0}, {}, None)

    def _number(self, nodes: dict[int, int], half: dict[tuple[int, str], int], done: int | None) -> int:
        """State for trie nodes with their edits; ``half``: nodes that are reached if the given letter follows, as a swap;
        ``done``: edits of a stem that the word has begun with."""
        todo = list(nodes.items())
        while todo:  # letters of an entry that the word leaves out
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in nodes.items():
            if node in self.stem_edits and e <= self.stem_edits[node]:
                done = e if done is None else min(done, e)
        key = (frozenset(nodes.items()), frozenset(half.items()), done)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((nodes, half, done))
            self.moves.append({})
            whole = [e for node, e in nodes.items() if node in self.word_edits and e <= self.word_edits[node]]
            self.ends.append(min([*whole, *([done] if done is not None else [])], default=None))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        nodes, half, done = self.states[state]
        after: dict[int, int] = {to: cost for (to, letter), cost in half.items() if letter == c}
        begun: dict[tuple[int, str], int] = {}
        for node, e in nodes.items():
            steps = [(node, e + 1)] if node else [(0, e + 1)]  # a letter too many
            steps += [(child, e + (x != c)) for x, child in self.children[node].items()]
            for to, cost in steps:
                if cost <= self.most[to] and after.get(to, 99) > cost:
                    after[to] = cost
            for x, child in self.children[node].items() if self.swaps else ():
                to = self.children[child].get(c) if x != c else None
                if to is not None and e + 1 <= self.most[to] and begun.get((to, x), 99) > e + 1:
                    begun[to, x] = e + 1
        return self._number(after, begun, done)

    def edits(self, word: str) -> int | None:
        """Edits between the word and the nearest entry, None if none is near enough."""
        state = self.start
        for c in word:
            if c not in self.letters:
                c = "\0"
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            if state == self.dead:
                return None
        return self.ends[state]


@dataclass(frozen=True)
class Model:
    """Words, stems, words that only look like misspellings, and the weights of the features (the first: constant)."""

    words: tuple[str, ...]
    stems: tuple[str, ...]
    innocent: frozenset[str]
    weights: tuple[float, ...]


class Matcher(dict):
    """Cache from a word to None, or to 1 for an entry and 0.5 for a misspelling; holds a limited number of words and of states."""

    def __init__(self, model: Model, most: int = 100_000, most_states: int = 20_000):
        super().__init__()
        self.model, self.most, self.most_states = model, most, most_states
        self.automaton = Automaton(list(model.words), list(model.stems), swaps=True)

    def __missing__(self, word: str) -> float | None:
        if len(self) >= self.most:
            self.clear()
        if len(self.automaton.states) >= self.most_states:
            self.automaton.forget()
        e = self.automaton.edits(word)
        if e is None and self._disguised(word):
            e = 1
        out = None if e is None else 1.0 if e == 0 else None if word in self.model.innocent else 0.5
        if len(word) < 64:
            self[word] = out
        return out


    def _disguised(self, word: str) -> bool:
        """Whether a word that no edits explain is an entry with letters repeated, with signs for letters or, of four letters, with two swapped."""
        edits = self.automaton.edits
        once = _RUN.sub(r"\1", word)
        if once != word and len(once) >= 4 and edits(once) == 0:
            return True
        if len(word) == 4 and any(edits(word[:i] + word[i + 1] + word[i] + word[i + 2:]) == 0 for i in range(3)):
            return True
        signs = sum(c in SIGNS for c in word)
        if not signs or len(word) < 4 or 2 * signs > len(word):
            return False
        open_ = re.compile("".join("." if c in SIGNS else re.escape(c) for c in word))
        return any(len(w) == len(word) and open_.fullmatch(w) for w in self.model.words) or any(
            all(a == b or a in SIGNS for a, b in zip(word, s)) for s in self.model.stems if 4 <= len(s) <= len(word))


def tokens(text: str, matcher: Matcher) -> list[tuple[int, str]]:
    """(place, word) in order. A word with signs between its letters stays whole if the matcher knows it, else it is cut at them."""
    out = []
    for m in _TOKEN.finditer(text):
        word = m.group()
        if word.isalnum() or "_" in word and _WORD.fullmatch(word) or matcher[word] is not None:
            out.append((m.start(), word))
        else:
            out += [(m.start() + w.start(), w.group()) for w in _WORD.finditer(word)]
    return out


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans of quotations, in order and apart, of any length.

    A quotation that is not closed ends at its paragraph or where the next one
    of its kind begins. A straight mark opens where no word ends and closes
    where none begins, in the same paragraph; the others may close in a later one.
    """
    spans: list[tuple[int, int]] = []
    begun: dict[str, tuple[int, int | None]] = {}  # kind of mark: start, end of the paragraph if that is past

    def close(kind: str, at: int, paired: bool) -> None:
        start, paragraph = begun.pop(kind)
        spans.append((start, at if paired or paragraph is None else paragraph))

    def open_(kind: str, at: int) -> None:
        if kind in begun:
            close(kind, at, False)
        begun[kind] = (at, None)

    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for m in _MARK.finditer(text):
        mark, at = m.group(), m.start()
        if mark[0] == "\n":
            if '"' in begun:  # the next straight mark may be an opening one
                close('"', at, False)
            begun = {k: (start, at if end is None else end) for k, (start, end) in begun.items()}
        elif mark == '"':
            if '"' in begun and not word(at + 1):
                close('"', at + 1, True)
            elif not word(at - 1):
                open_('"', at)
        elif mark == "“" and "„" in begun:
            close("„", at + 1, True)
        elif mark in "“«„":
            open_(mark, at)
        else:
            kind = "«" if mark == "»" else "“" if "“" in begun else "„"
            if kind in begun:
                close(kind, at + 1, True)
    for kind in list(begun):
        close(kind, len(text), False)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Sums over the hits of a text; a misspelling counts half, a hit as far as it is not quoted.
FEATURES = ("constant", "abuse", "quoted", "nearby", "density")


def features(text: str | None, matcher: Matcher) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Features of a text and its hits: (word number, edits > 0, quotation from 0 to 1)."""
    low = (text or "").lower()
    placed = tokens(low, matcher) if any(c in low for c in SIGNS) else None
    words = [w for _, w in placed] if placed is not None else _WORD.findall(low)
    at = [i for i, w in enumerate(words) if matcher[w] is not None]
    if not at:
        return [1.0, 0.0, 0.0, 0.0, 0.0], []
    spans = quotations(low)
    inside = [False] * len(words)
    if spans:
        k = 0
        for i, start in enumerate([p for p, _ in placed] if placed is not None else (m.start() for m in _WORD.finditer(low))):
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            if k == len(spans):
                break
            inside[i] = spans[k][0] < start
    hits, quoted, mass = [], 0.0, []
    for i in at:
        near = words[max(0, i - WINDOW): i + WINDOW + 1]
        q = 0.7 * inside[i] + 0.3 * (not REPORTING.isdisjoint(near)) - 0.2 * (not ADDRESS.isdisjoint(near))
        q = min(1.0, max(0.0, q))
        quoted += q
        mass.append((1 - q) * matcher[words[i]])
        hits.append((i, int(matcher[words[i]] < 1), q))
    nearby, first, held = 0.0, 0, 0.0
    for k, i in enumerate(at):
        held += mass[k]
        while at[first] < i - 2 * WINDOW:
            held -= mass[first]
            first += 1
        nearby = max(nearby, held)
    density = 100 * sum(mass) / len(words)
    return [1.0, math.log1p(sum(mass)), math.log1p(quoted), math.log1p(nearby), math.log1p(density)], hits


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing only."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the word before them (as a checksum), each once per run of rows and kind of text."""
    seen: set[tuple[str, int, int]] = set()
    letters = 0

    def rows() -> pa.RecordBatch:
        words, before, toxic = zip(*seen)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.int64()), pa.array(toxic, pa.int32())], ["word", "before", "toxic"])

    for batch in it:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = _WORD.findall((text or "").lower())
            letters += len(text or "")
            seen.update((w, zlib.crc32(v.encode()), toxic) for v, w in zip(["", *words], words))
            # Words with signs inside, too: what usual texts have of them is no disguise.
            seen.update((w, 0, toxic) for w in _TOKEN.findall((text or "").lower()) if not _WORD.fullmatch(w))
            if len(seen) > 200_000 or seen and letters > 1 << 25:
                yield rows()
                seen.clear()
                letters = 0
    if seen:
        yield rows()


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of up to ``sample`` labelled documents that are not held out, by a hash of their id; one row per text."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).filter("toxic is not null and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    at, n = F.xxhash64("doc_id", F.lit(1)), known.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    known = known.filter(F.pmod(at, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(at, "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")  # at most ``sample`` rows
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("h")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from labelled texts; without both kinds of labels the model scores 0 or 1 throughout."""
    rows = training_rows(docs, labels, doc_id, text, toxic, sample)
    rows = stored(rows.repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism)), "toxicity-rows")
    n, n_pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_neg = n - n_pos
    if not n_pos or not n_neg:
        return Model((), (), frozenset(), (25.0 if n_pos else -25.0, 0.0, 0.0, 0.0, 0.0))
    # A word counts once per word before it, not per text: copies of a text and passages that many share say it in one context only.
    words = rows.mapInArrow(lean(_contexts), "word string, before long, toxic int").distinct().groupBy("word").agg(
        F.sum("toxic").cast("long").alias("pos"), F.sum(1 - F.col("toxic")).cast("long").alias("neg"))
    words = stored(words, "toxicity-words")
    n_pos, n_neg = words.agg(F.sum("pos"), F.sum("neg")).first()
    if not n_pos or not n_neg:
        return Model((), (), frozenset(), (-25.0, 0.0, 0.0, 0.0, 0.0))
    base = n_pos / (n_pos + n_neg)
    # Twice the log-likelihood ratio; so many words and stems are tried that chance alone gives high values.
    p = F.col("pos") / (F.col("pos") + F.col("neg"))
    gain = 2 * (F.col("pos") * F.log(p / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - p) / (1 - base))).otherwise(0.0))
    lift = F.col("pos") / n_pos / ((F.col("neg") + 0.5) / n_neg)
    least = 10 + 2 * math.log(max(words.count(), 1))
    good = (F.col("pos") > 0) & (lift >= LIFT) & (gain >= least)
    stem = F.explode(F.array(*[F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEM_LENGTHS])).alias("word")
    stems = words.select(stem, "pos", "neg").filter("word is not null").groupBy("word").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum((F.col("pos") > 0).cast("long")).alias("n"))
    top = lambda df: [r["word"] for r in df.filter(good).orderBy(F.desc(gain), "word").collect()]
    kept: set[str] = set()
    begins = lambda w: any(w[:k] in kept for k in STEM_LENGTHS)
    for s in sorted(top(stems.filter(F.col("n") >= CONTINUATIONS)), key=len):
        if not begins(s):
            kept.add(s)
    entries = [w for w in top(words.filter(F.length("word") >= 3)) if not begins(w)]
    model = Model(tuple(sorted(entries)), tuple(sorted(kept)), frozenset(), (0.0,) * len(FEATURES))

    def suspects(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in it:
            yield batch.filter(pa.array([matcher[w] == 0.5 for w in batch.column("word").to_pylist()], pa.bool_()))

    usual = words.filter("neg > 0").filter(lift < LIFT).select("word").mapInArrow(lean(suspects), "word string")
    model = Model(model.words, model.stems, frozenset(r["word"] for r in usual.collect()), model.weights)

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in it:
            x = [features(t, matcher)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    got = rows.mapInArrow(lean(measured), "x array<double>, toxic int").groupBy("x", "toxic").count().toPandas()
    x, y, w = np.array(got["x"].tolist(), dtype=float), got["toxic"].to_numpy(dtype=float), got["count"].to_numpy(dtype=float)
    return Model(model.words, model.stems, model.innocent, tuple(logistic(x, y, w).tolist()))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression (the constant is free) by Newton steps; hits never speak against toxicity."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta = beta + step
        beta[[1, 3, 4]] = np.maximum(beta[[1, 3, 4]], 0)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``: struct of score (0 to 1), hits, misspelt, quoted (hits more likely quoted than meant).

    Whole texts are read; null and empty ones have no hits and get the score of
    a text without any. All other columns stay as they are; ``out`` replaces a
    column of that name. Equal texts get equal scores. An empty table stays so.
    """

    @F.pandas_udf("score double, hits long, misspelt long, quoted long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model)  # its words and states end with the task
        for texts in batches:
            rows = []
            for t in texts:
                x, hits = features(t, matcher)
                z = sum(a * b for a, b in zip(x, model.weights))
                rows.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(hits), sum(h[1] for h in hits), sum(h[2] > 0.5 for h in hits)))
            yield pd.DataFrame(rows, columns=["score", "hits", "misspelt", "quoted"])
        del matcher
        hand_back()

    return docs.withColumn(out, judge(F.col(text)))

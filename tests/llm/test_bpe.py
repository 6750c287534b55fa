import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import bpe
from gridloom.llm.queries import QUERIES

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODER = bpe.encoder(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})
ODD = [
    "", " ", "  ", "a", " a", "  a", "\n a", "a\n\nb", "it's'd 'sam's ''s !'s \n's 'r 'ree 'rev'll'l", "x  \n  y\t", "9a9 9'9", "'", "''", "' '", " 's", "\xa0's", "a　b  ", "\x1c\x1d a",
    "<|endoftext|>", "\0a\0", "é🙂ß 漢字 ١٢ Ⅷ ²", "a" * 5000, " " * 5000 + "x", "ab" * 3000 + "!" * 3000, "🙂" * 3000, "\r\n\r\n",
]


def check(texts):
    ids, offsets, counts = ENCODER.encode(texts)
    data, sizes = ENCODER.decode(ids, offsets, counts)
    ends = np.cumsum(counts)
    assert [ids[e - n: e].tolist() for e, n in zip(ends, counts)] == [THEIRS.encode_ordinary(t) for t in texts]
    assert data.tobytes().decode() == "".join(texts) and sizes.tolist() == [len(t.encode()) for t in texts]


def test_odd_texts_together_and_alone():
    check(ODD)
    for t in ODD:
        check([t])


def test_all_code_points():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 100_000):
        check([f"a{c}a {c}1" for c in points[start: start + 100_000]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("  \n\t'''sdrevlmt!.aé9_\xa0"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    check(texts)


def test_pieces_are_those_of_the_pattern():
    rnd = random.Random(2)
    pattern = regex.compile(tokenizers.PATTERN)
    for _ in range(300):
        t = "".join(rnd.choice(" \n'srevlab9!\t") for _ in range(rnd.randrange(1, 300)))
        data, bounds, n = bpe.piece_bounds([t])
        assert [data[a:b].decode() for a, b in zip(bounds, bounds[1:])] == pattern.findall(t) and n.tolist() == [len(pattern.findall(t))]


def test_small_cache():
    e = bpe.Encoder(ENCODER.ranks, most=3)
    assert e.encode(["one two three four five six one two"])[0].tolist() == THEIRS.encode_ordinary("one two three four five six one two")


def test_operators(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*ODD, None, "same", "same"])] + [(None, "x", 2)], "doc_id long, text string, ids int").repartition(2)
    coded = bpe.encode(df, PATH)
    by = {r["doc_id"]: r["text"] for r in rows(df)}
    assert all(r["ids"] == THEIRS.encode_ordinary(by[r["doc_id"]] or "") for r in rows(coded))
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in rows(bpe.decode(coded, PATH))} == {k: v or "" for k, v in by.items()}
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = THEIRS.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_steps_are_short_and_memory_goes_back(monkeypatch):
    import pyarrow as pa

    from gridloom.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(["a b" * 100_000] * 4 + [None])], ["text"])
    assert [(a, b) for a, b, _ in bpe._runs(batch, "text")] == [(0, 1), (1, 2), (2, 3), (3, 5)]
    calls = []
    monkeypatch.setattr(common, "hand_back", lambda: calls.append(1))
    assert list(common.lean(iter)([1, 2])) == [1, 2] and len(calls) == 2

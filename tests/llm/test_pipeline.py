from collections import Counter

import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gridloom.llm import bpe, mixing
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_are_those_of_the_plan():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "mix_sources", "byte_bpe"]


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pipeline.drop_toxic(spark, docs, sf)
    assert got.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in got.collect()}
    right = [(d in kept) == (t == 0) for d, t in labels.items()]
    assert sum(right) / len(right) > 0.97


def test_one_of_each_group_stays(spark, docs):
    twice = docs.union(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 100000)).withColumn("toxicity", F.lit(1))
    rows = [(r.doc_id, r.text) for r in twice.select("doc_id", "text").collect()]
    got = pipeline.keep_one_of_near_copies(spark, twice, SF)
    assert got.columns == twice.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in brute(rows)})


def test_mix_and_encode(spark, docs):
    mixed = pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix_sizes(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == want
    encoding = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(pipeline.tokenizer_file()), special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    out = pipeline.encode_texts(spark, mixed, SF).collect()
    assert len(out) == sum(want.values())
    assert all(r.ids == encoding.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_run_and_empty_documents(spark, docs):
    assert set(pipeline.run(spark, SF).columns) == {"doc_id", "ids", "offsets", "n_tokens"}
    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_rows_that_hold_nothing(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a " * 50000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:2]:
        assert stage(spark, odd, SF).count() == 4
    assert pipeline.mix_sources(spark, odd, SF).filter("doc_id = 2").count() == 1
    assert pipeline.encode_texts(spark, odd, SF).count() == 4


def test_encoded_texts_are_decoded(spark, docs, monkeypatch):
    assert run_here(docs.limit(5)) == 5
    monkeypatch.setattr(bpe, "encoder", lambda path, ranges: Faulty(path))
    with pytest.raises(Exception, match="do not decode to themselves"):
        run_here(docs.limit(5))


class Faulty:
    """An encoder that decodes one byte wrongly."""

    def __init__(self, path):
        self.own = bpe.Encoder(bpe.read_ranks(path))

    def encode(self, texts):
        return self.own.encode(texts)

    def clear(self):
        self.own.clear()

    def decode(self, *tokens):
        data, sizes = self.own.decode(*tokens)
        data[len(data) // 2] ^= 1
        return data, sizes


class Here:
    """A DataFrame's part that the stage uses, run in this process."""

    def __init__(self, docs):
        self.docs, self.schema = docs, docs.schema

    def __getitem__(self, name):
        return self.docs[name]

    def select(self, *columns):
        self.rows = self.docs.select(*columns).toArrow()
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.out = sum(b.num_rows for b in run(self.rows.to_batches()))
        return self

    def withColumn(self, *_):  # noqa: N802
        return self


def run_here(docs):
    return pipeline.encode_texts(None, Here(docs), SF).out

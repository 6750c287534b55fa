from pyspark.sql import functions as F

from gridloom.operators import encode


def test_dictionary_gives_the_codes_of_label_encode(spark, folder, monkeypatch):
    """By list, broadcast and join; nulls, repeats and a column that is missing."""
    rows = [(i, f"v{i * 7 % 23:02d}" if i % 5 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, b int").repartition(4)
    want = sorted(tuple(r) for r in encode.label_encode(df, ["a", "b"]).select("id", "a_enc", "b_enc").collect())
    found = encode.fit_encoder(df, folder, ["a", "b", "gone"])
    for listed, small in ((200, 50_000), (2, 50_000), (2, 1)):
        monkeypatch.setattr(encode, "LISTED_CLASSES", listed)
        monkeypatch.setattr(encode, "SMALL_DICTIONARY", small)
        got = encode.encode_with(df, encode.load_encoder(spark, folder)).select("id", "a_enc", "b_enc").collect()
        assert sorted(tuple(r) for r in got) == want
        later = spark.createDataFrame([("new", 9), ("v01", 2), (None, None)], "a string, b int")
        coded = [tuple(r) for r in encode.encode_with(later, found).select("a", "a_enc", "b_enc").orderBy(F.col("a").asc_nulls_first()).collect()]
        nan, v01 = (found.filter(F.col("value") == v).first()["code"] for v in ("nan", "v01"))
        assert coded == [(None, nan, -1), ("new", -1, -1), ("v01", v01, 2)]
        assert encode.encode_with(later, found, None).filter("a = 'new'").first()["a_enc"] is None


def test_empty_table_and_no_columns(spark, folder):
    df = spark.createDataFrame([], "a string")
    found = encode.fit_encoder(df, f"{folder}/empty", ["a"])
    assert found.count() == 0 and encode.fit_encoder(df, f"{folder}/none", ["b"]).count() == 0
    assert encode.encode_with(df, found).collect() == []

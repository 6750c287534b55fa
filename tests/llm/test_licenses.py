import math
from collections import Counter


from gridloom.llm import licenses as lic
from gridloom.llm.queries import QUERIES

GPL, MIT = lic.TEMPLATES["GPL-3.0"], lic.TEMPLATES["MIT"]
FILES = [
    ("a/LICENSE", MIT), ("a/b/x.txt", "words words"), ("a/b/c/y.txt", "words\n" + GPL + "\nmore words " * 50), ("a/b/c/z.txt", None), ("a/b/d/LICENSE", GPL.upper()),
    ("a/b/d/e/f/g.txt", ""), ("q.txt", "no licence here"), ("ab/x.txt", "mit und der"), ("a/b/d/LICENSE2", "Released, under the MIT license"), (None, "text"), (None, MIT),
    ("/rooted/x", "nothing"), ("a/b/d/e/long.txt", "under the " * 40000), ("a/near.txt", "Licensed to us under a licence of version 14.0.2, the Apache way"), ("a/b/x.txt", "words words"),
]


def brute(files):
    docs = [lic.tokens(t or "") for _, t in files]
    df = Counter(w for d in docs for w in set(d))
    known = {w for t in lic.TEMPLATES.values() for w in lic.tokens(t)}
    idf = lambda w: math.log((1 + len(docs)) / (1 + (df[w] if w in known else 0))) + 1

    def cos(a, b):
        x, y = ({w: n * idf(w) for w, n in Counter(v).items()} for v in (a, b))
        dot = sum(x[w] * y.get(w, 0) for w in x)
        return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if dot else 0

    def best(text):
        return max(((round(cos(lic.tokens(text), lic.tokens(t)), 12), [-ord(c) for c in name], name) for name, t in lic.TEMPLATES.items()))

    own = []
    for p, t in files:
        whole, lines = best(t or ""), [best(x) for x in (t or "").split("\n")]
        top = max(lines, key=lambda x: x[0])
        own.append((whole[2], whole[0], True) if whole[0] >= 0.6 else (top[2], top[0], False) if top[0] >= 0.6 else (None, None, False))
    held = {}
    for (p, _), (name, score, whole) in zip(files, own):
        if whole and p is not None:
            d = p.rpartition("/")[0]
            held[d] = min(held.get(d, (9, "", "")), (-score, p, name))
    out = []
    for (p, _), (name, score, whole) in zip(files, own):
        up, got = (p or "").rpartition("/")[0], None
        while name is None and p is not None:
            if up in held:
                got = held[up]
                break
            if not up:
                break
            up = up.rpartition("/")[0]
        out.append((p, name, None if score is None else round(score, 9), whole, got and got[2], got and got[1]))
    return sorted(out, key=str)


def ours(df):
    return sorted(((r.path, r.licence, None if r.score is None else round(r.score, 9), r.licence_file, r.inherited, r.inherited_from) for r in df.collect()), key=str)


def test_brute_force(spark):
    df = spark.createDataFrame([(*f, 1, "x") for f in FILES], "path string, text string, kept int, score string").repartition(3)
    got = lic.scan(df)
    assert ours(got) == brute(FILES) and "kept" in got.columns
    for r in got.filter("licence is not null and not licence_file").collect():
        text = next(t for p, t in FILES if p == r.path)
        assert lic.tokens(text[r.start: r.stop]) == lic.tokens(GPL)


def test_empty(spark):
    assert lic.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_light_words_alone_stay_below():
    w = lic.Weights({"the": 1.0, "under": 1.5, "mit": 9.0, "license": 6.0, "released": 8.0}, 12.0)
    v = {"MIT": w.vector(lic.tokens(MIT))}
    heavy = lic.heavy_words(v, 0.6)
    assert "mit" in heavy and "the" not in heavy
    assert lic.cosine(w.vector([x for x in lic.tokens(MIT) if x not in heavy]), v["MIT"]) < 0.6


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    files = [(f"{r.source}/{r.lang}/{r.doc_id // 100}/{r.doc_id}", r.text) for r in docs]
    got = QUERIES["op6_license_scan"](spark, sf)
    assert ours(got) == brute(files)
    marked = {r.doc_id for r in docs if any(t in r.text for t in lic.TEMPLATES.values())}
    assert marked and marked <= {r.doc_id for r in got.filter("licence is not null").collect()}


def found(spark, texts):
    """(licence, licence_file, licences) of each text, among texts without any."""
    files = [(f"d{i}/x", t) for i, t in enumerate(texts)] + [(f"e{i}/x", f"plain words number {i} the of and to in you may use it") for i in range(40)]
    got = {r.path: r for r in lic.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert all(got[p].licence is None and got[p].licences == [] for p, _ in files[len(texts):])
    return [(r.licence, r.licence_file, [x.licence for x in r.licences]) for r in (got[f"d{i}/x"] for i in range(len(texts)))]


def test_full_texts_are_licence_files(spark):
    names = list(lic.TEXTS)
    got = found(spark, ["Copyright (c) 2020 Some Body\n\n" + t for t in lic.TEXTS.values()])
    assert got == [(n, True, [n]) for n in names]


def test_wrapped_and_inner_notices_and_two_licences(spark):
    inner = "some words that come before it " * 20
    got = found(spark, [
        inner + MIT + " " + inner, inner + "\nThis work is licensed\nunder the GNU General Public\nLicense, version 3.\n" + inner,
        lic.TEXTS["MIT"] + "\n\n" + lic.TEXTS["Apache-2.0"], inner + MIT + "\n" + inner + "Licensed under CC BY-SA 4.0.",
        *(inner + t + " " + inner for _, t in lic.NOTICES)])
    assert got[0] == ("MIT", False, ["MIT"]) and got[1] == ("GPL-3.0", False, ["GPL-3.0"])
    assert got[2][1] and got[2][2] == ["MIT", "Apache-2.0"] and got[3][2] == ["MIT", "CC-BY-SA-4.0"]
    assert [x[0] for x in got[4:]] == [n for n, _ in lic.NOTICES]


def test_windows_are_cosines_and_places(spark):
    weights = lic.Weights({w: 1 + i / 7 for i, w in enumerate(lic.tokens(MIT))}, 4.0)
    text = "İx the the " * 9 + "under the license the MIT, the released " + "under a b " * 9
    (name, score, start, stop, full, size), = lic.Windows([("MIT", MIT, False, weights)], 0.6).find(text)
    words, t = lic.tokens(text), weights.vector(lic.tokens(MIT))
    assert (name, full, size) == ("MIT", False, 5)
    assert round(score, 8) == round(max(lic.cosine(weights.vector(words[i: i + 5]), t) for i in range(len(words) - 4)), 8)
    assert round(lic.cosine(weights.vector(lic.tokens(text[start: stop])), t), 8) == round(score, 8)


def test_clashing_names(spark):
    df = spark.createDataFrame([("a/x", MIT, 1, 2, 3, 4, "old")], "path string, text string, `_f` int, `a.b` int, `_dir` int, `_own` int, licence string")
    out = lic.scan(df)
    assert out.columns[:5] == ["path", "_f", "a.b", "_dir", "_own"] and "text" not in out.columns
    assert tuple(out.first())[:6] == ("a/x", 1, 2, 3, 4, "MIT")

"""Mixing sources to target weights by pivotal dependent rounding.

DataFrame operations only. Each source's documents are taken target / size
times on average; whole copies are given outright, the fractions are rounded
against each other: two documents at a time, words move from one to the other
at random until one of them has a whole number, and what is left of the other
goes on. Blocks of documents are rounded side by side, their remainders meet in
the blocks of the next level of a reduction tree, so the words a source gives
miss its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored, word_count

#: Weights by the sources' code-point order, repeated; a source gives at most CAP times its size.
WEIGHTS = (1, 2, 3)
CAP = 3
#: Documents of one block of the reduction tree, on average.
BLOCK = 128
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, source: str = "source", size: str = "size") -> DataFrame:
    """(source, rows, source_size, target) for rows of (source, size).

    Sources are ranked by code point, null last; ``weights`` repeat along the
    ranks. Targets share the total size by weight; a target above ``cap`` times
    its source's size stops there, and the excess is shared anew until none is
    above. A source of size 0 gets 0; an empty table gives no rows.
    """
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"), F.sum(size).alias("source_size"))
    by = stored(_ranked(by), "mix-sources")
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    by = by.select("source", "rows", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, None
    full = F.lit(float(cap)) * F.col("source_size")
    while True:  # each round caps at least one more source, as the share only grows
        above = F.col("weight") * F.lit(share) >= full
        n, held, left = by.agg(
            F.sum(above.cast("long")), F.sum(F.when(above, full).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n is None or n == capped or not left:
            break
        capped, share = n, (total - held) / left
    return by.select("source", "rows", "source_size", F.least(F.col("weight") * F.lit(share), full).alias("target"))


def _ranked(by: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in code-point order, null last: rows are numbered within ranges of names."""
    by = by.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce(F.encode("source", "UTF-8"), F.lit(b""))})
    by = stored(by.repartitionByRange("_null", "_name").withColumn("_part", F.spark_partition_id()), "mix-ranges")
    before = by.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_name")) - 1
    return by.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("rank", F.col("_own") + F.col("_before")).drop(
        "_null", "_name", "_part", "_own", "_before")


def _chance(*of: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))


_ITEM = "struct<doc_id:bigint,size:bigint,repeats:bigint,whole:bigint,part:double>"


def _fold(seed: int):
    """Moves words between the carried item and the next; the one that got whole goes to ``done``."""

    def step(acc: Column, x: Column) -> Column:
        a, b = acc["carried"], x
        words_a, words_b = a["part"] * a["size"], b["part"] * b["size"]
        up = F.least((1 - a["part"]) * a["size"], words_b)  # most that can go from b to a
        down = F.least(words_a, (1 - b["part"]) * b["size"])  # most that can go from a to b
        rises = _chance(F.lit(seed), a["doc_id"], a["size"], b["doc_id"], b["size"]) * (up + down) < down

        def with_part(item: Column, part: Column) -> Column:
            return F.struct(*[item[n].alias(n) for n in ("doc_id", "size", "repeats", "whole")], part.cast("double").alias("part"))

        # Of a rise, either a gets whole or b gives its last word; of a fall, the other way round.
        a_full, a_empty = (1 - a["part"]) * a["size"] <= words_b, words_a <= (1 - b["part"]) * b["size"]
        done = F.when(rises, F.when(a_full, with_part(a, F.lit(1))).otherwise(with_part(b, F.lit(0)))).otherwise(
            F.when(a_empty, with_part(a, F.lit(0))).otherwise(with_part(b, F.lit(1))))
        rest = F.when(rises, F.when(a_full, with_part(b, (words_b - up) / b["size"])).otherwise(with_part(a, (words_a + up) / a["size"]))).otherwise(
            F.when(a_empty, with_part(b, (words_b + down) / b["size"])).otherwise(with_part(a, (words_a - down) / a["size"])))
        return F.when(a.isNull(), F.struct(b.alias("carried"), acc["done"].alias("done"))).otherwise(
            F.struct(rest.alias("carried"), F.concat(acc["done"], F.array(done)).alias("done")))

    return step


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, block: int = BLOCK,
           doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Copies of each group of rows with equal (doc_id, source, size).

    Returns doc_id, source, size, repeats (rows of the group), copies (all rows
    of the group together), source_size, target. Sizes are words; null text has
    none. A row gets at most ``cap`` copies. Rows that repeat are rounded as one
    group, so that no key grows a block. Texts without words are taken 0 times
    when the source has no words, else by their own chance: they move nothing.
    Null doc_id and null source are values like others. Reruns agree: chance
    comes from hashes of ``seed``, doc_id and size.
    """
    items = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    items = stored(items.groupBy("source", "doc_id", "size").agg(F.count("*").alias("repeats")), "mix-items")
    sizes = items.select("source", (F.col("size") * F.col("repeats")).alias("size"))
    targets = stored(source_targets(sizes, weights, cap, "source", "size"), "mix-targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    expected = each * F.col("repeats")
    near = F.round(expected)  # 2.9999999999999996 is 3
    expected = F.when(F.abs(expected - near) < 1e-9, near).otherwise(expected)
    t = targets.withColumnRenamed("source", "_s")
    items = items.join(t, items["source"].eqNullSafe(t["_s"])).drop("_s").withColumn("expected", expected).withColumns(
        {"whole": F.floor("expected").cast("long"), "part": F.col("expected") - F.floor("expected")})
    facts = ["source", "rows", "source_size", "target"]
    open_ = (F.col("part") > 0) & (F.col("size") > 0)
    alone = F.col("whole") + F.when(F.col("size") == 0, (_chance(F.lit(seed), "doc_id") < F.col("part")).cast("long")).otherwise(0)
    settled = items.filter(~open_).select("doc_id", "source", "size", "repeats", alone.alias("copies"), "source_size", "target")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / block)).cast("long")
    level = items.filter(open_).select(
        *facts, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), blocks).alias("block"),
        F.struct(*[F.col(c) for c in ("doc_id", "size", "repeats", "whole", "part")]).cast(_ITEM).alias("item"))
    most = items.agg(F.max(blocks)).first()[0] or 1
    order = lambda x: F.struct(_chance(F.lit(seed + 1), x["doc_id"], x["size"]).alias("at"), x.alias("x"))
    empty = F.struct(F.lit(None).cast(_ITEM).alias("carried"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    while True:
        sorted_ = F.transform(F.array_sort(F.transform(F.collect_list("item"), order)), lambda o: o["x"])
        folded = level.groupBy(*facts, "block").agg(sorted_.alias("items")).select(*facts, "block", F.aggregate("items", empty, _fold(seed)).alias("f"))
        folded = stored(folded.select(*facts, "block", "f.carried", "f.done"), "mix-level")
        done = folded.select(*facts, F.explode("done").alias("i"))
        settled = settled.unionByName(_copies(done, F.col("i.part").cast("long")))
        if most <= 1:
            break
        most = -(-most // block)
        level = folded.select(*facts, F.floor(F.col("block") / block).alias("block"), F.col("carried").alias("item"))
    last = folded.select(*facts, F.col("carried").alias("i"))
    return settled.unionByName(_copies(last, (_chance(F.lit(seed + 2), "i.doc_id", "i.size") < F.col("i.part")).cast("long")))


def _copies(done: DataFrame, more: Column) -> DataFrame:
    return done.select("i.doc_id", "source", "i.size", "i.repeats", (F.col("i.whole") + more).alias("copies"), "source_size", "target")


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, copies counted)."""
    out = decide(docs, **options)
    at = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("at")
    each = F.floor(F.col("copies") / F.col("repeats")) + (F.col("at") <= F.col("copies") % F.col("repeats")).cast("long")
    return out.select("*", at).select("doc_id", "source", "size", "source_size", "target", each.cast("long").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    Rows that repeat doc_id, source and size share their copies; only when
    these don't divide evenly are such rows numbered to tell who gets one more.
    """
    names = docs.columns
    out = decide(docs, doc_id=doc_id, source=source, text=text, **options).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("repeats").alias("_r"), F.col("copies").alias("_k"))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    df = df.withColumns({"_a": F.col(f"_row.`{doc_id}`").cast("long"), "_b": F.col(f"_row.`{source}`"), "_c": word_count(F.col(f"_row.`{text}`"))})
    df = df.join(out, df["_a"].eqNullSafe(out["_d"]) & df["_b"].eqNullSafe(out["_s"]) & (df["_c"] == out["_z"]))
    even = F.col("_k") % F.col("_r") == 0
    base = F.floor(F.col("_k") / F.col("_r"))
    plain = df.filter(even).select("_row", base.alias("_n"))
    number = F.row_number().over(Window.partitionBy("_d", "_s", "_z").orderBy(F.xxhash64(F.col(f"_row.`{text}`"))))
    uneven = df.filter(~even).select("_row", (base + (number <= F.col("_k") % F.col("_r")).cast("long")).alias("_n"))
    rows = plain.unionByName(uneven).filter("_n > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))))
    return rows.select("_row.*")

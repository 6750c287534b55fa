"""Registered queries of the operators, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, lexical, licenses, manifest, mixing, ngram_join, quality, topk, toxicity, url_filter, vector_join, warc
from gridloom.llm.common import LOWER, UPPER, table
from gridloom.llm.shingles import WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _chat_sql(template: chat.Template = chat.Template()) -> str:
    """Turns, loss and lengths from the table itself: an escape adds one character to each control string of a text."""
    marks = " ".join(f"when '{r}' then {len(a + b)}" for r, (a, b) in template.marks.items())
    bare = sum(map(len, template.other))
    heads = {}
    for c in template.controls():
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    control = "|".join(rf"{re.escape(k)}\\*(?:{'|'.join(v)})" for k, v in heads.items())
    escapes = lambda c: f"len(regexp_extract_all({c}, '{control}'))"
    named = " or ".join(f"role = '{r}'" for r in template.marks)
    follows = " or ".join(f"(before = '{a}' and role in ({', '.join(map(repr, b))}))" for a, b in template.order.items())
    loss = ", ".join(map(repr, template.loss))
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
  select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (select *, coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), '{chat.START}') as before from turns),
each as (select *, role || chr(10) || text || chr(10) as line, case when role in ({loss}) then text else '' end as lost, ({follows}) as fits,
  length(text) + {escapes('text')} + case role {marks} else {bare} end + case when {named} then 0 else length(role) + {escapes('role')} end as chars from placed)
select conv_id, count(*) as n_turns, sha256(string_agg(line, '' order by turn nulls first, role, text)) as turns_sha256,
  sum(length(lost))::bigint as loss_chars, sha256(string_agg(lost, '' order by turn nulls first, role, text)) as loss_sha256,
  sum(chars)::bigint as formatted_chars, bool_and(fits) as valid from each group by conv_id"""


@query("op3_chat_formatting", _chat_sql())
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    ).select("conv_id", "t.*")
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


@query("op5_mix_sources")
def _(spark, sf):
    return mixing.mix_sizes(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


@query("op7_url_filter", f"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
ruled as (
  select page_id, host, path, case
    {" ".join(f"when {_fits(h, p)} then '{h + p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} end as rule from split)
select page_id, host, path, rule, case when rule in ({", ".join(repr(h + p) for h, p, v in RULES if v == "block")}) then 'block' else 'allow' end as verdict from ruled""")
def _(spark, sf):
    out = url_filter.judge(table(spark, sf, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


#: Documents reachable by links; ``nodes`` has id, ``links`` both directions a, b.
_REACH = "reach(a, b) as (select id, id from nodes union select r.a, l.b from reach r join links l on r.b = l.a)"


@query("op4_ngram_jaccard_join", f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
sets as (
  select doc_id as id, list_distinct(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) end) as s from words),
nodes as (select id, len(s) as n from sets),
held as (select id, unnest(s) as x from sets),
likely as (select l.id as a, r.id as b, count(*) as shared from held l join held r on l.x = r.x and l.id < r.id group by all),
pairs as (select a, b from likely join nodes p on p.id = a join nodes q on q.id = b where 100 * shared >= {ngram_join.PERCENT} * (p.n + q.n - shared)),
links as (select a, b from pairs union all select b, a from pairs),
{_REACH}
select id as doc_id, n as n_shingles, component_id from nodes join (select a as id, min(b) as component_id from reach group by a) using (id)""")
def _(spark, sf):
    return ngram_join.join_documents(table(spark, sf, "documents"))


def tokenizer_file() -> str:
    """Ranks of the registered queries; every worker has the package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op9_byte_bpe")
def _(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), tokenizer_file())


_USABLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


@query("op8_exact_top_k", f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)) as q from embeddings where {_USABLE}),
s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, rank, vec_id, score from (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s) where rank <= 5""")
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors.filter("vec_id % 50 = 0"), vectors, 5)


@query("op10_embedding_near_dedup", f"""
with recursive nodes as (select vec_id as id from embeddings),
v as (select vec_id as id, embedding::double[] as e from embeddings where {_USABLE} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.id as a, b.id as b from v a join v b on a.id <> b.id and list_cosine_similarity(a.e, b.e) >= {vector_join.COSINE}),
{_REACH}
select id as vec_id, coalesce(n, 0)::bigint as n_links, component_id, id = component_id as kept
from (select a as id, min(b) as component_id from reach group by a) left join (select a as id, count(*) as n from links group by a) using (id)""")
def _(spark, sf):
    return vector_join.range_join(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query("op1_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels"))
    score = F.col("toxicity.score")
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
        "toxicity.hits", "toxicity.misspelt", "toxicity.quoted")


@query("op2_warc", f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, case when payload_bytes >= {warc.LEAST} then min(page_id) over (partition by payload_digest) end as least from d)
select page_id, payload_bytes, payload_digest, case when least is not null and page_id is distinct from least then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from least then least end as refers_to from f""")
def _(spark, sf):
    path = warc.write_archives(table(spark, sf, "pages").select("page_id", "url", "html"))
    return warc.page_records(warc.read_archives(spark, path))


@query("op6_license_scan")
def _(spark, sf):
    part = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("null"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("null")), F.coalesce("lang", F.lit("null")), part, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    files = table(spark, sf, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files)


#: Columns of a leaf of the registered manifest, and the levels that its SQL can climb (16^6 rows a source).
LEAF, CLIMB = ["doc_id", "source", "lang", "n_chars", "text"], 6


def _climb(name: str, levels: int) -> str:
    """CTEs <name>1, ...: nodes of each level; <name>p1, ...: proof so far and the digest that the claim folds to."""
    out = []
    for k in range(levels):
        out.append(f"""{name}o{k} as materialized (select tree from {name}{k} group by tree having count(*) > 1),
{name}{k + 1} as materialized (select tree, place // 16 as place, sha256(string_agg(node, '' order by place)) as node from {name}{k} where tree in (from {name}o{k}) group by 1, 2),
{name}p{k + 1} as materialized (
  select p.id, p.tree, p.place // 16 as place, sha256(string_agg(case when s.place = p.place then p.fold else s.node end, '' order by s.place)) as fold,
    p.proof || coalesce(string_agg(case when s.place <> p.place then s.node end, '' order by s.place), '') as proof
  from {name}p{k} p join {name}{k} s on s.tree = p.tree and s.place // 16 = p.place // 16 where p.tree in (from {name}o{k}) group by p.id, p.tree, p.place, p.fold, p.proof
  union all select * from {name}p{k} where tree not in (from {name}o{k}))""")
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in [*[f"d.{c}" for c in LEAF[:-1]], text]) + ")"


@query("op13_merkle_manifest", f"""
with crc as (
  select doc_id, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint), lambda c, b:
    list_reduce(list_transform(range(8), lambda i: i::bigint), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295::bigint) as c
  from (select distinct doc_id from documents)),
d as (
  select row_number() over () as id, d.doc_id, d.source, {_leaf_sql("d.text")} as leaf,
    case when xor(c, 4294967295::bigint) % 5 = 0 then {_leaf_sql(f"translate(d.text, '{UPPER}', '{LOWER}')")} end as claim
  from documents d left join crc on crc.doc_id = d.doc_id),
m as materialized (
  select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from d),
s0 as materialized (select tree, place, leaf as node from m),
sp0 as materialized (select id, tree, place, coalesce(claim, leaf) as fold, '' as proof from m),
{_climb("s", CLIMB)},
sub as materialized (select tree, node from ({" union all ".join(f"select tree, node from s{k} where tree not in (from so{k})" for k in range(CLIMB))})),
t0 as materialized (select 0 as tree, tree as place, node from sub),
tp0 as materialized (select p.id, 0 as tree, p.tree as place, fold, proof from sp{CLIMB} p),
{_climb("t", CLIMB)},
top as (select node as root from ({" union all ".join(f"select tree, node from t{k} where tree not in (from to{k})" for k in range(CLIMB))}))
select m.doc_id, m.leaf, sub.node as subroot, root, sha256(proof) as proof_sha256, fold as folded_root, fold = root as verified
from m join tp{CLIMB} p using (id) join sub on sub.tree = m.tree, top""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = manifest.digest([*LEAF[:-1], F.translate("text", UPPER, LOWER)])
    out = manifest.build(docs, LEAF, carry={"doc_id": F.col("doc_id"), "claim": F.when(tampered, claim)})
    proven = out.prove(out.members)
    root = F.lit(out.root).cast("string")
    folded = manifest.fold(F.col("proof"), F.coalesce("claim", "leaf"))
    return proven.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_quality_rules")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    weights = quality.fit(docs, table(spark, sf, "labels"))
    return quality.judge(docs, weights).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content")])


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op11_ranked_search", f"""
with d as (select row_number() over () as id, doc_id, {_TERMS} as t from documents),
sized as (select id, doc_id, len(t)::bigint as n from d where len(t) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as total from sized),
held as materialized (select id, term, count(*)::bigint as tf from (select id, unnest(t) as term from d) group by all),
asked as materialized (select distinct item_id, unnest({_TERMS}) as term from benchmark),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
  from (select term, count(*)::bigint as df from held where term in (select term from asked) group by 1), whole),
scored as (
  select item_id, h.id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score
  from asked join weights using (term) join held h using (term) join sized s on s.id = h.id, whole group by all)
select item_id, cast(rank as int) as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls first) as rank from scored join sized using (id) where score > 0)
where rank <= 10""")
def _(spark, sf):
    index = lexical.build(table(spark, sf, "documents"))
    return lexical.search(index, table(spark, sf, "benchmark"), 10)

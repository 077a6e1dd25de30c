"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Links (a, b) of a CTE ``links`` and nodes (id) of a CTE ``nodes``, closed into (id, component_id).
CLOSURE = """
both_ways as (select a, b from links union select b, a from links),
reach(id, other) as (select id, id from nodes union select r.id, l.b from reach r join both_ways l on l.a = r.other),
closed as (select id, min(other) as component_id from reach group by id)"""

NEAR_SQL = f"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
      else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
n as (select doc_id, len(s) as n from s),
one as (select doc_id, unnest(s) as x from s),
links as (select p.doc_id as a, q.doc_id as b from one p join one q on p.x = q.x and p.doc_id < q.doc_id
      join n pn on pn.doc_id = p.doc_id join n qn on qn.doc_id = q.doc_id
      where 5 * least(pn.n, qn.n) >= 4 * greatest(pn.n, qn.n)
      group by p.doc_id, q.doc_id, pn.n, qn.n having 100 * count(*) >= 80 * (pn.n + qn.n - count(*))),
nodes as (select doc_id as id from documents),{CLOSURE}
select n.doc_id, n.n as n_shingles, c.component_id, n.doc_id = c.component_id as kept from n join closed c on c.id = n.doc_id"""


@query("op9_minhash_near_dedup", NEAR_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


@query("op4_quality_resampling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.quality import fit, resample

    docs = table(spark, sf_dir, "documents")
    return resample(docs, fit(docs, table(spark, sf_dir, "labels")))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.packing import best_fit, clustered

    items = clustered(table(spark, sf_dir, "documents"))
    return best_fit(items, length=F.col("words"), cluster=F.col("cluster"), tie=F.col("same"))


def learnable(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fifth; a null doc_id counts as an empty one, whose remainder is 0."""
    return docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)


@query("op7_language_ppm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return predict(docs, train(learnable(docs))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


EMBEDDING_SQL = f"""
with recursive
v as (select vec_id, label, embedding::double[] as e from embeddings),
good as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select p.vec_id as a, q.vec_id as b from good p join good q on p.label = q.label and p.vec_id < q.vec_id and len(p.e) = len(q.e)
      where list_cosine_similarity(p.e, q.e) >= 0.93),
nodes as (select vec_id as id from v),{CLOSURE},
n as (select a, count(*) as n from both_ways group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join closed c on c.id = v.vec_id left join n on n.a = v.vec_id"""


@query("op2_embedding_ego_join", EMBEDDING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.embedding_dedup import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings"))


#: The escape of chat_format as SQL.
_ESCAPED = r"regexp_replace(coalesce({0}, ''), '([<\[])(\\*)(/?s>|/?INST\]|OUT\])', '\1\\\2\3', 'g')"

CHAT_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
      (3 + sum(case when role = 'assistant' then 10 else 14 end + length(replace(replace({_ESCAPED.format("role")}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'))
       + length({_ESCAPED.format("text")})))::bigint as formatted_chars
from t group by conv_id"""


@query("op1_chat_format", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.chat_format import MESSAGE, fold_events, read_back, render

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    events = rows.unionByName(probe).select("conv_id", F.col("turn").alias("seq"), F.lit(MESSAGE).alias("kind"), F.lit(None).cast("string").alias("message"), "role", "text")
    chats = render(fold_events(events)).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["text"]), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_document_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_bpe_trie")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bourselake.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


#: CRC-32 of a text of ASCII characters {0}: a step for each bit after the byte is added.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end))"""
_FIELD_SQL = "coalesce(strlen({0}::varchar) || ':' || {0}, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
#: The levels of trees (tree, level, d) over lists of digests.
_LEVELS_SQL = """{0}(tree, level, d) as (select {1} union all
      select tree, level + 1, list_transform(range((len(d) + 2) // 3), lambda i: sha256(list_aggregate(d[3 * i + 1:3 * i + 3], 'string_agg', ''))) from {0} where len(d) > 1)"""

MERKLE_SQL = f"""
with recursive
l as (select doc_id, coalesce('=' || source, '') as tree, {_LEAF_SQL.format("text")} as leaf,
      {_LEAF_SQL.format("replace(text, chr(10), '')")} as stripped, {_CRC_SQL.format("coalesce(doc_id::varchar, '')")} as crc from documents),
p as (select doc_id, tree, leaf, case when crc % 2 = 0 then stripped else leaf end as claim,
      row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from l),
{_LEVELS_SQL.format("below", "tree, 0, list(leaf order by place) from p group by tree")},
subroots as (select tree, d[1] as subroot, row_number() over (order by encode(tree)) - 1 as seat from below where len(d) = 1),
{_LEVELS_SQL.format("above", "'', 0, list(subroot order by seat) from subroots")},
steps as (select b.level, floor(p.place / 3 ** b.level)::bigint as spot, b.d, p.doc_id, p.leaf, p.claim, p.tree, p.place, s.subroot
          from p join below b on b.tree = p.tree and len(b.d) > 1 join subroots s on s.tree = p.tree
          union all
          select t.height + a.level, floor(s.seat / 3 ** a.level)::bigint, a.d, p.doc_id, p.leaf, p.claim, p.tree, p.place, s.subroot
          from p join subroots s on s.tree = p.tree join (select tree, max(level) as height from below group by tree) t on t.tree = p.tree join above a on len(a.d) > 1),
runs as (select tree, place, level, spot % 3 as own, d[spot - spot % 3 + 1:spot - spot % 3 + 3] as d from steps),
others as (select tree, place, level, list_aggregate(d[1:own], 'string_agg', '') as l, list_aggregate(d[own + 2:], 'string_agg', '') as r from runs),
folded(tree, place, level, digest) as (select tree, place, 0, claim from p union all
          select f.tree, f.place, f.level + 1, sha256(coalesce(o.l, '') || f.digest || coalesce(o.r, '')) from folded f join others o on o.tree = f.tree and o.place = f.place and o.level = f.level),
ends as (select tree, place, arg_max(digest, level) as folded_root from folded group by tree, place),
proofs as (select tree, place, sha256(string_agg(coalesce(l, '') || coalesce(r, ''), '' order by level)) as proof_sha256 from others group by tree, place),
top as (select d[1] as root from above where len(d) = 1)
select p.doc_id, p.leaf, s.subroot, top.root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = top.root as verified
from p join subroots s using (tree) join ends e using (tree, place) left join proofs q using (tree, place), top"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.merkle import manifest, proofs, text_digest

    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: text_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(number % 2 == 0, leaf(F.translate("text", "\n", ""))).alias("claim"))
    rows = rows.withColumn("claim", F.coalesce("claim", "leaf"))
    found = proofs(manifest(rows), "claim")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which one document of ten goes round and round from a word on, as its doc_id's CRC says; without doc_id, none."""
    from bourselake.llm.periodic_runs import words_of

    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", number.alias("h"), F.floor(number / 10).alias("g"), F.when(number % 10 == 0, words_of(F.col("text"))).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("rest", F.col("n") - F.col("a")).withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)))
    times = F.ceil(F.col("rest") / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a").cast("int") + 1, F.col("p").cast("int")), times))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), F.col("rest").cast("int")))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.periodic_runs import periodic_runs

    found = periodic_runs(looped(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).alias("listed"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _secrets_sql() -> str:
    from bourselake.llm.secret_scan import BASE, MORE

    one = "select doc_id, '{kind}' as kind, {i} as n, string_split_regex(t, {re}) as p, regexp_extract_all(t, {re}) as m, regexp_extract_all(t, {re}, {group}) as g, {least} as least from d"
    found = [one.format(kind=r.kind, i=i, group=r.group, least=r.least, re="'" + r.java.replace("'", "''") + "'") for i, r in enumerate(BASE + MORE)]
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(found)}),
s as (select doc_id, kind, n, least, unnest(range(len(m))) as i, p, m, g from f),
x as (select doc_id, kind, n, list_sum(list_transform(p[1:i + 1], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i], lambda y: length(y))), 0) as start,
      length(m[i + 1]) as size from s where length(g[i + 1]) >= least),
l as (select doc_id, count(*) filter (n = 0) as n_assign, count(*) filter (n = 1) as n_access, count(*) filter (n = 2) as n_hex,
      string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, n) as spans,
      string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, n) filter (n < 3) as base from x group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join l using (doc_id)"""


@query("op12_secret_scan", _secrets_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bourselake.llm.secret_scan import BASE, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

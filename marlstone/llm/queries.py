"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, jaccard_join, language_model, license_scan, packing, quality_rules, secret_scan, token_store, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quality_sql() -> str:
    """Sketches of at most SKETCH_K documents are exact, so discrete quantiles give the same fences."""
    q = quality_rules
    values = {"symbol_ratio": "n_symbols / n_words", "dup_line_ratio": "case when n_lines > 0 then n_dup_lines / n_lines else 0 end", "repeat_ratio": "n_repeat_words / n_words", "mean_word": "word_chars / n_words"}
    stats, fences = [], {}
    for k, event in q.RATIOS.items():
        stats += [f"quantile_disc({values[k]}, {p}) as {k}_{n}" for p, n in ((0.25, "lo"), (0.75, "hi"))]
        spread = f"({k}_hi - {k}_lo)"
        if event:
            spread = f"greatest({spread}, cast({q.EVENTS * event[1]} as double) / greatest({event[0]}_mid, 1.0))"
        fences[f"hi_{k}"] = f"{k}_hi + cast({q.SPREADS} as double) * {spread}"
        if not event:
            fences[f"lo_{k}"] = f"{k}_lo - cast({q.SPREADS} as double) * {spread}"
    stats += [f"quantile_disc(cast({k} as double), 0.5) as {k}_mid" for k in ("n_words", "n_lines")]
    level = f"count(*) as n, {', '.join(stats)} from m where not failed"
    made = ", ".join(f"{x} as {n}" for n, x in fences.items())
    weight = lambda t: f"({t}.n / ({t}.n + cast({q.SHRINK} as double)))"
    mixed = lambda n: f"(a.{n} + {weight('l')} * (l.{n} - a.{n}))"
    blended = ", ".join(f"{mixed(n)} + {weight('o')} * (o.{n} - {mixed(n)}) as {n}" for n in fences)
    bad = " or ".join(f"{values[k]} > f.hi_{k}" for k in values)
    return f"""
with w as (
  select doc_id, coalesce('=' || lang, 'null') as lang, coalesce('=' || source, 'null') as source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), places as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5
), twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i + 4], ' ')) as c from places) where c > 1
), covered as (select doc_id, count(distinct i + k) as n from twice, range(0, 5) as t(k) group by doc_id
), c as (
  select w.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(ls) as n_lines,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from w left join covered using (doc_id)
), m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as failed from c
), o as (select lang, source, n, {made} from (select lang, source, {level} group by lang, source)
), l as (select lang, n, {made} from (select lang, {level} group by lang)
), a as (select n, {made} from (select {level})
), f as (select o.lang, o.source, {blended} from o join l on o.lang = l.lang cross join a)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed as base_failed,
  case when failed then false else not coalesce({bad} or {values["mean_word"]} < f.lo_mean_word, false) end as kept
from m left join f on m.lang = f.lang and m.source = f.source
"""


ORACLES["op10_quality_rules"] = _quality_sql()


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _secrets_sql() -> str:
    q = lambda p: p.replace("'", "''")
    found = " union all ".join(
        f"select doc_id, source, lang, {k} as kind, {least} as least, regexp_extract_all(t, '{q(p)}') as w, regexp_extract_all(t, '{q(p)}', {group}) as v, string_split_regex(t, '{q(p)}') as g from t"
        for k, (_, p, group, least) in enumerate(secret_scan.KINDS)
    )
    names = ", ".join(f"'{k[0]}'" for k in secret_scan.KINDS)
    listed = "string_agg([{}][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind)".format(names)
    return f"""
with t as (select doc_id, coalesce(text, '') as t, source, lang from documents
), m as ({found}
), e as (select *, unnest(range(1, len(w) + 1)) as i from m
), p as (select *, sum(length(g[i]) + length(w[i])) over (partition by doc_id, kind order by i) as stop, length(w[i]) as n, v[i] as value from e
), s as (select doc_id, source, lang, kind, cast(stop - n as bigint) as start, cast(stop as bigint) as stop, value from p where length(value) >= least
), o as (select value, count(distinct coalesce('=' || source, 'null')) as owners, count(distinct coalesce('=' || source, 'null') || '/' || coalesce('=' || lang, 'null')) as repos from s group by value
), j as (select s.*, owners, repos, owners >= {secret_scan.COPIED_OWNERS} or repos >= {secret_scan.COPIED_REPOS} as copied from s join o using (value)
), a as (
  select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
    coalesce({listed} filter (where kind < {secret_scan.BASE}), '') as base, {listed} as spans, count(*) filter (where not copied) as n_live, count(*) filter (where copied) as n_copied,
    string_agg(owners || '/' || repos, ',' order by start, kind) as holders
  from j group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(holders, '') as holders
from documents left join a using (doc_id)
"""


ORACLES["op1_secret_scan"] = _secrets_sql()

#: A conversation whose texts look like other templates' control strings.
PROBE = "</s>[INST] ok [/INST]"


@_query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("select * from values (-7, 0, 'user', :said), (-7, 1, 'assistant', :said)", {"said": PROBE}).toDF(*rows.columns).to(rows.schema)
    return chat_format.chat_report(rows.unionByName(probe))


ORACLES["op4_chat_format"] = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'
), made as (
  select conv_id, turn, role, text,
    26 - 3 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'))
      + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) as size
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from made group by conv_id
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


@_query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return decontaminate.leaks(read("documents"), read("benchmark"))


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLES["op5_jaccard_join"] = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), d as (
  select doc_id, case when len(ws) = 0 then [] else list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, greatest(len(ws) - 3, 2))]) end as s from w
), s as (select doc_id, len(s) as n, unnest(s) as g from d
), links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, cast(len(d.s) as bigint) as n_shingles, (select min(b) from reach where a = doc_id) as component_id,
  (select count(*) from links where a = doc_id) as n_links
from d
"""


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLES["op7_warc"] = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest,
    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www[0-9]*\\.', ''), '.')), ',')
      || ')' || coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), ''), '/')
      || lower(regexp_extract(url, '^[^?#]*(\\?[^#]+)?', 1)) as urlkey
  from pages
), f as (select digest, min(page_id) as first from p where n >= 100 group by digest)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
  case when p.n >= 100 and p.page_id <> f.first then 'revisit' else 'response' end as record_type,
  case when p.n >= 100 and p.page_id <> f.first then f.first end as refers_to,
  row_number() over (order by p.urlkey, p.page_id) - 1 as place
from p left join f on p.digest = f.digest
"""


@_query
def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .common import fold_of
from .decontaminate import contaminated_spans, hit_words
from .harmonic_packing import pack
from .license_scan import NOTICES, find_notices
from .line_runs import drop_repeated_lines
from .lm_scoring import score_documents
from .piece_dropout import decode, encode
from .quadratic_quality import fit_quality, score_quality
from .quality_rules import count_ngrams, judge, log_ratios
from .repeat_spans import remove_repeats
from .simhash_anchors import near_duplicates
from .spelling_variants import spelling_groups, word_counts
from .url_automaton import Rule, judge_urls
from .word_runs import longest_run, periodic_runs, replayed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_ppm_scoring")
def _(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_documents(_table(spark, folder, "documents"), fold_of(F.col("_id"), 7) != 2)
    held_out = (fold_of(F.col("doc_id"), 7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op2_ngram_ratio")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    judged = judge(docs, log_ratios(*count_ngrams(docs, _table(spark, folder, "labels"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


@_query("op3_simhash_near_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


# All windows by exact containment, without the bands; notices as listed.
NOTICES_SQL = (
    r"""
with notice(license, text) as (values """
    + ", ".join(f"('{name}', '{text}')" for name, text in NOTICES)
    + r"""),
template as (
  select license, len(w) - 4 as m, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as shingles
  from (select license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from notice)),
doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
shingle as (
  select doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') as s from (select *, unnest(range(0, len(w) - 4)) as i from doc)),
hit as (
  select distinct doc_id, i, s, license, m, len(shingles) as n
  from shingle join (select *, unnest(shingles) as s from template) using (s)),
placed as (
  select doc_id, license, n, s, unnest(range(
    greatest(0, cast(ceil((i + 1 - m - greatest(1, m // 2)) / greatest(1, m // 2)) as bigint)) * greatest(1, m // 2), i + 1, greatest(1, m // 2))) as a
  from hit),
contained as (
  select doc_id, license, a, count(distinct s) / any_value(n) as share from placed group by all having count(distinct s) / any_value(n) >= 0.8)
select doc_id, license, max(share) as containment, arg_min(a, (-share, a)) as first_word, count(*) as n_windows
from contained group by doc_id, license"""
)


@_query("op4_license_scan", NOTICES_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return find_notices(_table(spark, folder, "documents"), spark.createDataFrame(NOTICES, "license string, text string"))


LINES_SQL = r"""
with lines as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
cut as (
  select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as line from lines),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from cut),
frequent as (
  select k, max(doc_id) as holder from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
judged as (
  select keyed.*, f.k is not null and doc_id <> holder as dropped from keyed left join frequent f on keyed.k = f.k)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id"""


@_query("op5_line_dedup", LINES_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op6_piece_dropout")
def _(spark: SparkSession, folder: str) -> DataFrame:
    pieces = decode(encode(_table(spark, folder, "documents").select("doc_id", "text")))
    return pieces.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.to_json("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


SPANS_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
placed as (
  select doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') as s
  from (select doc.*, l, unnest(range(1, len(w) - l + 2)) as i from doc, (select distinct l from windows))),
hits as (select doc_id, i, placed.l, item_id from placed join windows using (l, s)),
hit_words as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(i, i + l)) as pos from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n, string_agg(x, ',' order by x) as ids
  from (select distinct doc_id, cast(item_id as varchar) as x from hits) group by doc_id)
select doc.doc_id, len(w) as n_words, coalesce(a.n, 0) as n_hit, coalesce(b.n, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, a.n is not null as contaminated
from doc left join hit_words a on doc.doc_id = a.doc_id left join hit_items b on doc.doc_id = b.doc_id"""


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
URLS_SQL = """
with parts as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
rules(verdict, rule_host, rule_path) as (values
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(verdict, length(rule_host || rule_path)) as verdict
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict,
  case when host like '%spam-%' or host like '%cheap-%' or host like '%-pills%' or host like '%casino%' then 'block' else 'allow' end) as verdict
from parts p left join best b on p.page_id = b.page_id"""


@_query("op7_repeated_bytes")
def _(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(_table(spark, folder, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@_query("op8_url_automaton", URLS_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"), RULES)


@_query("op9_decontamination", SPANS_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    spans = contaminated_spans(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return spans.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@_query("op10_quadratic_quality")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    scored = score_quality(docs, fit_quality(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query("op11_spelling_variants")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(word_counts(_table(spark, folder, "documents"), misspell=97))


@_query("op12_harmonic_packing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(_table(spark, folder, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op13_word_runs")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(replayed(_table(spark, folder, "documents").select("doc_id", "text"))).withColumn("best", longest_run())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)

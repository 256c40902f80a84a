"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinolith.llm import filter_audit, html_extraction, language_id, media_mkv, near_dedup, packing, pieces, pii, secret_scan, token_counts, topk_search, url_filter, whitening
from kinolith.llm.shared import table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of documents in sequences of 2048, one row per piece."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest integer products of every fiftieth vector with all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found")).alias("spans"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, decoded again; decoded_sha256 is of the text that comes back."""
    model = public_tokenizers.path(PIECES)
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return coded.select(
        "doc_id", "n_bytes", "n_pieces", "n_fallback", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found")).alias("spans"),
    )


def op10_media_mkv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a Matroska file and read back."""
    return media_mkv.digests(media_mkv.store(table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the first four whitened components."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # a deviation beyond a long, from some ten billion vectors on, is null here and whole in the operator
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from documents, in all orders, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_topk_search": op3_topk_search,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_counts": op5_token_counts,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_url_filter": op7_url_filter,
        "op8_language_id": op8_language_id,
        "op9_pii": op9_pii,
        "op10_media_mkv": op10_media_mkv,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_filter_audit": op12_filter_audit,
        "op13_html_extraction": op13_html_extraction,
    }


def _urls_sql() -> str:
    """op7 in SQL: terms are runs of letters and digits, so those between boundaries are the URL's words."""
    fits = lambda host, path: f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda pick: " ".join(f"when {fits(h, p)} then '{pick(v, h, p)}'" for v, h, p in ordered)
    terms = ", ".join(f"('{t}', {w})" for t, w in url_filter.VOCABULARY.items())
    block = url_filter.BLOCK_AT
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""with terms(term, weight) as (values {terms}),
u as (select page_id, list_distinct(regexp_split_to_array(translate(coalesce(url, ''), '{upper}', '{lower}'), '[^\\p{{L}}\\p{{N}}]+')) as words, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
w as (select page_id, unnest(words) as term from u), h as (select page_id, count(*) filter (weight >= {block}) as strict, count(*) filter (weight < {block}) as soft, sum(weight) as weight from w join terms using (term) group by 1),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
j as (select p.*, coalesce(strict, 0)::int as strict_hits, coalesce(soft, 0)::int as soft_hits, coalesce(weight, 0)::int as weight from p left join h using (page_id))
select page_id, host, path, case {case(lambda v, h, p: h + p)} end as rule, case {case(lambda v, h, p: v)} when weight >= {block} then 'block' else 'allow' end as verdict, strict_hits, soft_hits, weight from j"""


#: Components by all pairs with a common shingle. The words are joined by blanks, which no word holds.
_NEAR_SQL = """with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from d),
e as (select doc_id, unnest(s) as x, len(s) as n from s),
p as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r as (select doc_id as id, doc_id as label from s union select l.y, r.label from r join (select a as x, b as y from p union all select b, a from p) l on l.x = r.id),
c as (select id, min(label) as component_id from r group by 1)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from s join c on id = doc_id"""

_TOP_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 5"""

#: Every order over the cells of each part.
_AUDIT_SQL = """with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by 1),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] as f from w left join l using (doc_id)),
c as (select part, f, list_sum(list_transform(f, lambda x: x::int)) as k, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, f),
x(i, f) as (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o as (select [a.i, b.i, c.i, d.i, e.i] as o, a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select o, filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
j as (select part, filter_order, step, n, good, toxic, k, f[o[step]] as own, len(list_filter(o[1 : step - 1], lambda i: f[i])) > 0 as before from c, s)
select part, filter_order, step::int as step, sum(case when own or before then 0 else n end)::bigint as kept, sum(case when own and not before then n else 0 end)::bigint as removed, sum(case when own and before then n else 0 end)::bigint as redundant, sum(case when own and k = 1 then n else 0 end)::bigint as unique_fails, sum(case when own and not before then good else 0 end)::bigint as good_lost, sum(case when own and not before then toxic else 0 end)::bigint as toxic_lost, sum(case when own then n * 120 // k else 0 end)::bigint as shapley from j group by all"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it over the whole table."""
    return {
        "op2_minhash_near_dedup": _NEAR_SQL,
        "op3_topk_search": _TOP_SQL,
        "op7_url_filter": _urls_sql(),
        "op12_filter_audit": _AUDIT_SQL,
    }

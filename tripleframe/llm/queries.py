"""The operators of this package as queries on the benchmark tables, and their SQL."""
from __future__ import annotations

import os
import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.llm import gram_join, iri_filter, languages, leaks, lines, near_literals, packing, quality, repeated_text, spellings, token_files, topk, whitening
from tripleframe.llm.rows import send_package
from tripleframe.plans.support import cut_lineage, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Where the vocabulary is; a parameter of the operators that need one.
TOKENIZER = os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        send_package(spark)
        return fn(spark, sf)
    QUERIES[fn.__name__] = run
    return run


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as literals: the key of the subject and the text."""
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("s"), F.col("text").alias("o"), "lang")


def _fold(n: int):
    return F.crc32(F.col("s").cast("string").cast("binary")) % n


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page url; a page is bad if its labels say low quality or toxic."""
    pages = _table(spark, sf, "pages").select(F.col("page_id").alias("s"), F.col("url").alias("o"))
    labels = _table(spark, sf, "labels").groupBy(F.col("doc_id").alias("l")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    outcomes = pages.join(labels, F.col("s") == F.col("l")).select("o", "bad")
    out = iri_filter.judge_iris(pages, RULES, iri_filter.host_reputation(outcomes))
    return out.select(F.col("s").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    described = quality.describe(documents(spark, sf))
    described = cut_lineage(described)
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("s"), "quality").where(_fold(4) != 2)
    scores = quality.score_quality(described, quality.fit_quality(described, labels))
    return scores.select(F.col("s").alias("doc_id"), (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    known = docs.where("lang is not null").where(_fold(5) != 0).select("o", F.concat(F.lit("@"), "lang").alias("o_type"))
    out = languages.tag_literals(docs, languages.learn_languages(known))
    return out.select(F.col("s").alias("doc_id"), (_fold(5) == 0).alias("held_out"), F.substr("o_type", F.lit(2)).alias("lang_pred"), "score")


@query
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    out = packing.pack_literals(documents(spark, sf), TOKENIZER)
    return out.select(F.col("s").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as flat token files in the shared folder, then counted by scanning those."""
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    written = token_files.write_token_files(documents(spark, sf), folder, TOKENIZER)
    counts = token_files.count_tokens(spark, written.select("path"))
    return written.join(counts, ["path", "ordinal"]).select(F.col("s").alias("doc_id"), "n_tokens")


@query
def op10_top_k_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("s"), F.col("embedding").alias("vector"))
    out = topk.top_k(rows, rows.where(F.col("s") % 20 == 0))
    return out.select(F.col("query").alias("query_id"), "rank", F.col("s").alias("vec_id"), "score")


SQL["op10_top_k_search"] = """
with good as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) v from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
     scored as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) score
                from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
     ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that leak a benchmark item, with the item."""
    items = _table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("o"))
    return leaks.leaks(documents(spark, sf), items).select(F.col("s").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows", "same_values")


@query
def op4_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = near_literals.near_literals(documents(spark, sf), width=2)
    return out.select(F.col("s").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


@query
def op11_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    out = gram_join.similar_literals(documents(spark, sf).select("s", "o"))
    return out.select(F.col("s").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component_s").alias("component_id"))


@query
def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Deviations beyond 64 bits, of some 10^8 vectors on, are NULL here; the operator has them."""
    out = whitening.whiten(_table(spark, sf, "embeddings").select(F.col("vec_id").alias("s"), F.col("embedding").alias("vector")))
    return out.select(F.col("s").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


@query
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    out = spellings.spelling_variants(documents(spark, sf).select("s", "o"), misspell=31)
    return out.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = repeated_text.drop_repeats(documents(spark, sf))
    return out.select(F.col("s").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("o").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.drop_repeated_lines(documents(spark, sf))
    return out.select(F.col("s").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("o").cast("binary"), 256).alias("kept_sha256"))


def _op2_sql() -> str:
    """Host reputation in SQL: the same moments, level by level."""
    fits = []
    for text, says in sorted(RULES, key=lambda r: -len(r[0])):
        at, begin = text.split("/", 1)
        fits.append((f"(host = '{at}' or host like '%.{at}') and starts_with(path, '/{begin}')", text, says))
    choose = lambda i, other: "case " + " ".join(f"when {f[0]} then '{f[i]}'" for f in fits) + f" else {other} end"

    def weight(rows: str, by: str) -> str:
        m = "(sum(bad) / sum(n))"
        v = f"((sum(bad * bad / n) - sum(bad) * {m} - (count(*) - 1) * ({m} * (1 - {m}))) / ((sum(n) - sum(n * n) / sum(n) - count(*) + 1) * ({m} * (1 - {m}))))"
        ok = f"{m} * (1 - {m}) > 0 and sum(n) - sum(n * n) / sum(n) - count(*) + 1 > 1e-9"
        return (f"select {by} up, sum(bad) b, sum(n) c, case when {ok} then 1 / least(greatest({v}, 0.001), 0.9) - 1 else 2.0 end w from {rows} group by {by}")

    def level(rows: str, key: str, by: str, prior: str, parents: str) -> str:
        mu = f"((bad + w * {prior}) / (n + w))"
        return f"select {key} nm, n, {mu} mu, {mu} - {iri_filter.Z} * sqrt({mu} * (1 - {mu}) / (n + w + 1)) bound from {rows} r join {parents} on r.{by} = up"

    return f"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{iri_filter._UPPER}', '{iri_filter._LOWER}') host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
     l as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels group by doc_id),
     h0 as (select host, cast(sum(bad) as double) bad, cast(count(*) as double) n from p join l on page_id = doc_id group by host),
     h as (select *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') dom, list_last(string_split(host, '.')) suf from h0),
     d as (select dom, suf, sum(bad) bad, sum(n) n from h group by dom, suf),
     s as (select suf, 0 top, sum(bad) bad, sum(n) n from d group by suf),
     wt as ({weight('s', 'top')}), ls as ({level('s', 'suf', 'top', '((b + 1) / (c + 2))', 'wt')}),
     ws as (select x.*, mu prior from ({weight('d', 'suf')}) x join ls on up = nm), ld as ({level('d', 'dom', 'suf', 'prior', 'ws')}),
     wd as (select x.*, mu prior from ({weight('h', 'dom')}) x join ld on up = nm), lh as ({level('h', 'host', 'dom', 'prior', 'wd')}),
     j as (select p.*, coalesce(lh.bound, ld.bound, ls.bound) bound from p left join lh on host = lh.nm
           left join ld on array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') = ld.nm left join ls on list_last(string_split(host, '.')) = ls.nm)
select page_id, host, path, {choose(1, 'null')} as rule, {choose(2, f"case when bound > {iri_filter.LIMIT} then 'block' else 'allow' end")} as verdict from j"""


SQL["op2_url_filter"] = _op2_sql()


def _shingle_sql(width: int, percent: int, more: str) -> str:
    """Components of documents linked by their shingles: an inverted index, counts of common shingles, and what links reach."""
    return f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{iri_filter._UPPER}', '{iri_filter._LOWER}'), '[ \\t-\\r]+'), lambda x: x <> '') ws from documents),
     g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {width} then [array_to_string(ws, ' ')]
             else list_transform(range(1, len(ws) - {width} + 2), lambda i: array_to_string(ws[i:i + {width - 1}], ' ')) end) g from w),
     n as (select doc_id, count(*) n from g group by doc_id),
     p as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
     l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= {percent} * (x.n + y.n - c)),
     e as (select a, b from l union all select b, a from l),
     r(k, c) as (select doc_id, doc_id from documents union select r.k, e.b from r join e on r.c = e.a),
     m as (select k, min(c) c from r group by k)
select k as doc_id, coalesce(n, 0) as n_shingles, c as component_id{more} from m left join n on k = doc_id"""


SQL["op4_minhash_near_dedup"] = _shingle_sql(2, 80, ", k = c as kept")
SQL["op11_ngram_jaccard_join"] = _shingle_sql(3, 90, "")

SQL["op1_substring_dedup"] = """
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') ws from documents),
     v as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) i from w)),
     f as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) r from v) where r > 1),
     c as (select distinct doc_id, unnest(range(i, i + 20)) pos from f),
     u as (select doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) pos from w),
     k as (select u.doc_id, count(*) n_words, count(c.pos) n_removed, string_agg(word, ' ' order by u.pos) filter (c.pos is null) kept
           from u left join c on u.doc_id = c.doc_id and u.pos = c.pos group by u.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join k on d.doc_id = k.doc_id"""

# Fixed value: 3988292384, the reflected polynomial of CRC-32, from which its table is made.
SQL["op13_spelling_variants"] = f"""
with recursive t as (select list(list_reduce(list_concat([i], [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) order by i) t from range(256) x(i)),
     o as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{iri_filter._UPPER}', '{iri_filter._LOWER}'), '[a-zÀ-ÿ]+')) w from documents),
     d as (select w, cast(doc_id as varchar) || ':' || w s, count(*) n from o where length(w) >= 7 group by all),
     b as (select w, n, flatten(list_transform(string_split(s, ''), lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [195, (unicode(x) & 63) | 128] end)) y from d),
     h as (select w, n, xor(list_reduce(list_concat([4294967295], y), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) h from b, t),
     k as (select case when h % 31 = 0 then w[1:cast(h % length(w) as integer)] || w[cast(h % length(w) as integer) + 2:] else w end word, n from h),
     c as (select word, cast(sum(n) as bigint) n from k where length(word) >= 7 group by word having sum(n) >= 2),
     x as (select word, n, unnest(range(1, length(word) + 1)) i from c),
     z as (select word, n, i, word[1:i - 1] || word[i + 1:] g from x),
     q as (select a.word, b.word other, b.n m from z a join z b on a.g = b.g and a.i = b.i and a.word <> b.word
           union select z.word, c.word, c.n from z join c on z.g = c.word union select c.word, z.word, z.n from z join c on z.g = c.word),
     f as (select word, count(*) n_near, max(m) m, arg_min(other, (-m, other)) form from q group by word),
     j as (select c.word, n, coalesce(n_near, 0) n_near, case when m >= 10 * n then form end form, case when m >= 10 * n then m end form_n from c left join f using (word)),
     r(word, root) as (select word, word from j union all select r.word, j.form from r join j on r.root = j.word where j.form is not null),
     s as (select word, arg_max(root, n) root from (select r.word, r.root, c.n from r join c on r.root = c.word) group by word)
select j.word, form, root, n, n_near, form_n from j join s on j.word = s.word"""

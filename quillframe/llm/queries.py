"""The numbered queries: thin forms of the operators over whole tables, as their contracts ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, ngram_join, packing, pii, quality, secrets, spelling, toxicity, urlfilter, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents")).drop("strings")


def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.fit(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col(out.columns[-1]).alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_pii_weak_supervision, op3_secret_scan, op4_pu_toxicity, op5_benchmark_decontamination, op6_language_id, op7_line_dedup, op8_warc_normaliser, op9_best_fit_packing, op10_quality_rules, op11_embedding_whitening, op12_url_filter, op13_spelling_variants)}

#: A-Z to lower case, and nothing else.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as g from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        few as (select g from s group by g having count(*) > 1),
        pair as (select distinct x.doc_id as a, y.doc_id as b from s x join few using (g) join s y on x.g = y.g and x.doc_id <> y.doc_id),
        shared as (select a, b, count(*) as i from pair join s x on x.doc_id = a join s y on y.doc_id = b and y.g = x.g group by a, b),
        link as (select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * i >= 90 * (p.n + q.n - i)),
        reach(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, l.b from reach r join link l on l.a = r.other)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(min(r.other), d.doc_id) as component_id
        from documents d left join n using (doc_id) left join reach r using (doc_id) group by d.doc_id, n.n""",
    "op7_line_dedup": rf"""
        with l as (select doc_id, i, ls[i] as line from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
        s as (select doc_id, i, list_sort(list_distinct(regexp_extract_all({_LOWER.format("line")}, '[^\x20\x09-\x0D]+'))) as w from l),
        c as (select w, row_number() over () as c, len(w) as n, min(struct_pack(d := doc_id, i := i)) as f from s where len(w) >= 1 group by w),
        e as (select c, n, f, unnest(w) as t from c),
        df as (select t, count(*) as n from e group by t),
        p as (select c, e.n, f, row_number() over (partition by c order by df.n, t) as at, t from e join df using (t)),
        pair as (select distinct x.c as a, y.c as b from p x join p y on x.t = y.t and x.f < y.f
          and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) and 5 * (x.at - 1) <= x.n and 5 * (y.at - 1) <= y.n),
        shared as (select a, b, count(*) as i from pair join e x on x.c = a join e y on y.c = b and y.t = x.t group by a, b),
        bad as (select distinct b from shared join c p on p.c = a join c q on q.c = b where 100 * i >= 80 * (p.n + q.n - i)),
        gone as (select doc_id, i from s join c on s.w = c.w where c.c in (select b from bad) or struct_pack(d := doc_id, i := i) <> f),
        kept as (select l.doc_id, count(g.i) as n, string_agg(line, chr(10) order by l.i) filter (where g.i is null) as text
          from l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
        select d.doc_id, coalesce(k.n, 0)::bigint as n_removed, sha256(case when d.text is not null then coalesce(k.text, '') end) as text_sha256,
          case when d.text is not null then coalesce(k.text, '') end as text
        from documents d left join kept k using (doc_id)""",
    "op8_warc_normaliser": """
        with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
        t as (select *, max(page_id) over (partition by h) as top from p),
        b as (select *, list_transform(range(0, 160, 5), lambda i: list_sum(list_transform(range(i, i + 5), lambda k:
                (((strpos('0123456789abcdef', x[k // 4 + 1]) - 1) >> (3 - k % 4)) & 1) << (4 - (k - i))))) as five from t)
        select page_id, octet_length(encode(h))::bigint as payload_bytes,
          array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::int + 1, 1)), '') as payload_digest,
          case when page_id = top then 'response' else 'revisit' end as record_type,
          case when page_id <> top then top end as refers_to from b""",
    "op5_benchmark_decontamination": rf"""
        with words as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        item as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(13, len(w)) as n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i+12], ' '))) as g from item where len(w) > 0),
        place as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from words, (select distinct n from win) where len(w) >= n),
        hit as (select doc_id, item_id, i, p.n from place p join win on win.n = p.n and win.g = array_to_string(w[i:i+p.n-1], ' ')),
        covered as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as at from hit) group by doc_id),
        found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
          sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
        from words left join covered using (doc_id) left join found using (doc_id)""",
    "op12_url_filter": rf"""
        with recursive rules(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        p as (select row_number() over () as row, page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
        u as (select row, page_id, html, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) as query from p),
        page as (select *, case when host <> '' then host || case when path = '' then '/' else path end || query end as node from u),
        tags as (select node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?(</script|\z)|<style\b.*?(</style|\z)|<title\b.*?(</title|\z)|<textarea\b.*?(</textarea|\z)|<template\b.*?(</template|\z)|<noscript\b.*?(</noscript|\z)', '', 'g'), '(?i)<(?:link|meta)\b[^>]*')) as tag from page where node is not null),
        named as (select node, tag, trim(regexp_extract(tag, '(?i)[\s"/](?:href|content)\s*=\s*"([^"]*)"', 1)) as v from tags
          where regexp_matches(tag, '(?i)^<link') and regexp_matches(tag, '(?i)\srel\s*=\s*"([^"]*\s)?canonical(\s[^"]*)?"') or regexp_matches(tag, '(?i)^<meta') and regexp_matches(tag, '(?i)http-equiv\s*=\s*"refresh"')),
        href as (select node, regexp_extract(replace(case when regexp_matches(tag, '(?i)^<meta') then regexp_extract(v, '(?i)url\s*=\s*(.*)', 1) else v end, '&amp;', '&'), '(?i)^https?://([^#]*)', 1) as t from named),
        target as (select node, {_LOWER.format("regexp_extract(t, '^[^/?]*')")} as host, substr(t, length(regexp_extract(t, '^[^/?]*')) + 1) as more from href where t <> ''),
        edge as (select node as a, host || case when more = '' or more like '?%' then '/' else '' end || more as b from target where host <> ''),
        both_ways as (select a, b from edge union select b, a from edge),
        reach(a, b) as (select distinct a, a from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
        node as (select node from page where node is not null union select b from edge),
        own as (select node, arg_max(verdict, length(r.host || r.path)) as verdict from node n join rules r on regexp_extract(node, '^[^/]*') = r.host and starts_with(regexp_extract(node, '^[^/]*([^?]*)', 1), r.path)
            or ends_with(regexp_extract(node, '^[^/]*'), '.' || r.host) and starts_with(regexp_extract(node, '^[^/]*([^?]*)', 1), r.path) group by node),
        class as (select c.a as node, bool_or(o.verdict = 'allow') as allow, bool_or(o.verdict = 'block') as block from (select a, b from reach union select node, node from node) c left join own o on o.node = c.b group by c.a),
        fit as (select row, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(verdict, length(r.host || r.path)) as verdict
          from page p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by row)
        select page_id, host, path, rule, coalesce(f.verdict, case when c.allow then 'allow' when c.block then 'block' else 'allow' end) as verdict
        from page p left join fit f using (row) left join class c on c.node = p.node""",
    "op13_spelling_variants": rf"""
        with recursive bits as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        runs as (select doc_id, run, count(*) as m from (select doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z' || chr(192) || '-' || chr(255) || ']+'))")} as run from documents) group by doc_id, run),
        coded as (select *, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + unicode(c) // 64, 128 + unicode(c) % 64] end)) as b from runs),
        summed as (select run, m, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from coded, bits),
        words as (select w as word, sum(m)::bigint as n from (select m, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as w from summed) group by w having length(w) >= 5 and sum(m) >= 3),
        cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as c from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
        pair as (select a.word as a, b.word as b, b.n from cut a join cut b on a.c = b.c and a.i = b.i and a.word <> b.word
          union select a.word, b.word, b.n from words a join cut b on a.word = b.c union select a.word, b.word, b.n from cut a join words b on a.c = b.word),
        best as (select a as word, count(*) as n_near, min(struct_pack(n := -n, w := encode(b))) as o from pair group by a),
        forms as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -o.n >= 2 * w.n then decode(o.w) end as form, case when -o.n >= 2 * w.n then -o.n end as form_n from words w left join best b using (word)),
        path(word, up) as (select word, word from forms union all select p.word, f.form from path p join forms f on f.word = p.up where f.form is not null)
        select f.word, f.form, p.up as root, f.n, f.n_near, f.form_n from forms f join path p on p.word = f.word join forms e on e.word = p.up where e.form is null""",
}

"""Queries over the driver's tables, one per operator, and their SQL for DuckDB."""

from __future__ import annotations

from quarry.llm import classifier, decontamination, licenses, mixing, neardups, pages, personal, repeats, search, secrets
from quarry.llm.common import table


def op1_top_k(spark, sf_dir):
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark, sf_dir):
    return classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents")).drop("found")


def op6_personal_data(spark, sf_dir):
    return personal.report(table(spark, sf_dir, "documents"))


def op7_repeats(spark, sf_dir):
    return repeats.removed(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op8_near_duplicates(spark, sf_dir):
    return neardups.classes(table(spark, sf_dir, "documents"))


def op9_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_main_text(spark, sf_dir):
    return pages.report(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_decontaminate, op3_mixing, op4_quality, op5_licenses, op6_personal_data, op7_repeats, op8_near_duplicates, op9_secrets, op10_main_text)}
#: For DuckDB. The operators whose results SQL can't give have tests against brute force instead.
ORACLE_SQL = {
    "op1_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
    "op2_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (select distinct item_id::varchar as item_id, array_to_string(w[i:i + 9], ' ') as win, least(len(w), 10) as n
         from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
sizes as (select distinct n from wins),
grams as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
          from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n)),
found as (select doc_id, i, n, item_id from grams join wins using (win, n)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from (select distinct doc_id, i, n from found)) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from found group by doc_id),
tokens as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from d),
freqs as (select term, count(*) as freq from tokens group by term),
lists as (select distinct string_split(win, ' ') as ws, win from wins),
parts as (select win, ws, unnest(ws) as term, generate_subscripts(ws, 1) - 1 as place from lists),
rarest as (select * from (select p.*, row_number() over (partition by win order by coalesce(freq, 0), place) as nth from parts p left join freqs using (term)) where nth <= 2),
cand as (select distinct doc_id, win, ws, pos - place - s as o from rarest join tokens using (term), (values (0), (1)) as t(s)),
near as (select doc_id, win from cand join d using (doc_id)
         where len(list_filter(range(len(ws)), lambda j: (o + j >= 0 and w[o + j + 1] = ws[j + 1]) or (o + j + 1 >= 0 and w[o + j + 2] = ws[j + 1]))) >= case when len(ws) < 10 then len(ws) else 9 end),
near_items as (select doc_id, count(distinct item_id) as n_near from (select distinct doc_id, win from near) join wins using (win) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near_items
from d left join places using (doc_id) left join items using (doc_id) left join near_items using (doc_id)""",
}

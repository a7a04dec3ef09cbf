"""op4: near-duplicate components of all documents."""

from __future__ import annotations

from rowloom.llm.minhash import near_duplicates

PERCENT = 85


def op4_minhash_near_dedup(spark, sf):
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), percent=PERCENT)


OP4_SQL = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from split where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as d, doc_id as r from split union select d, b from reach join links on r = a),
smallest as (select d, min(r) as component_id from reach group by d)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from split join smallest on doc_id = d left join sizes using (doc_id)
"""

QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
SQL = {"op4_minhash_near_dedup": OP4_SQL}

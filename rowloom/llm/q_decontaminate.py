"""op9: benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.llm.decontaminate import find


def op9_decontamination(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).select("doc_id", "_found.*")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
with split as (
  select 'd' as side, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
windows as (
  select distinct id as item_id, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from split where side = 'b' and len(w) > 0)),
grams as (
  select id as doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select id, w, m, unnest(range(1, len(w) - m + 2)) as i from split cross join (select distinct m from windows) where side = 'd' and len(w) >= m)),
found as (select doc_id, i, m, item_id from grams join windows using (m, win)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select id as doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from split left join hits on id = hits.doc_id left join named on id = named.doc_id where side = 'd'
"""

QUERIES = {"op9_decontamination": op9_decontamination}
SQL = {"op9_decontamination": OP9_SQL}

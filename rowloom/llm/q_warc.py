"""op5: archives of all pages, written and read back."""

from __future__ import annotations

from rowloom.llm.warc import round_trip


def op5_warc(spark, sf):
    return round_trip(spark.read.parquet(f"{sf}/pages.parquet"))


OP5_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from d)
select page_id, payload_bytes, payload_digest, case when first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from f
"""

QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": OP5_SQL}

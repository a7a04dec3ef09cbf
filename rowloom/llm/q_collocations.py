"""op12: phrases of each language that hold together."""

from __future__ import annotations

from rowloom.llm.collocations import collocations


def op12_collocations(spark, sf):
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
split as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from split where len(w) > 0),
totals as (select lang, count(*) as n from places group by lang),
grams as (
  select lang, m, w[i : i + m - 1] as g, count(*) as f
  from places cross join (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(w) group by all),
cands as (select * from grams where m >= 2 and f >= 30),
inside as (
  select lang, g[s : s + k - 1] as g, max(f) as longest
  from (select lang, g, f, k, unnest(range(1, m - k + 2)) as s from (select lang, g, f, m, unnest(range(2, m)) as k from cands))
  group by all),
alone as (
  select c.lang, c.m, c.g, c.f from cands c left join inside i on c.lang = i.lang and c.g = i.g
  where i.longest is null or 100 * cast(i.longest as hugeint) < 80 * cast(c.f as hugeint)),
cuts as (select lang, m, g, f, unnest(range(1, m)) as k from alone),
scored as (
  select c.lang, c.g, c.f as a, c.k, x.f as l, y.f as r, (2000000 * cast(c.f as hugeint)) // (cast(x.f as hugeint) + y.f) as score
  from cuts c join grams x on x.lang = c.lang and x.g = c.g[1 : c.k] join grams y on y.lang = c.lang and y.g = c.g[c.k + 1 : c.m]),
weakest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank,
    array_to_string(g, ' ') as phrase, a, l, r, score from weakest)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
SQL = {"op12_collocations": OP12_SQL}

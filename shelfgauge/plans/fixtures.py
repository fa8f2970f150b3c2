"""Feeds, model results and model answers derived from the given tables.

The statements run unchanged on Spark and in an oracle database; only the names of
the tables differ. They plant flaws by the document number, over all documents.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

#: supplier feed: one product per document
FEED = """
select 'P' || cast(d.doc_id as string) as product_id,
  (case d.doc_id % 4 when 0 then 'Women''s ' when 1 then 'Men''s ' when 2 then ''
     else 'Unisex ' end) || p.p_name as title,
  d.source as category,
  case when d.doc_id % 5 = 0 then null when d.doc_id % 7 = 0 then '  ' else p.p_type end
    as material,
  case when d.doc_id % 6 = 0 then p.p_brand || '/' || d.lang
    when d.doc_id % 11 = 0 then '' else d.lang end as colour,
  case when d.doc_id % 13 = 0 then null else d.text end as description,
  case when d.doc_id % 9 = 0 then '0' when d.doc_id % 17 = 0 then null
    when d.doc_id % 19 = 0 then '$$12'
    else cast(cast(p.p_retailprice as decimal(12,2)) as string) end as price,
  case d.doc_id % 4 when 0 then 'Women' when 1 then 'Men' when 2 then null
    else 'Unisex' end as gender,
  'S-XL' as size_range,
  'All Season' as season,
  case when d.doc_id % 4 = 1 then null else d.source end as keywords,
  case when d.doc_id % 8 = 3 then '' else 'In Stock' end as stock_status
from $documents d join $part p on p.p_partkey = d.doc_id
"""

#: the same feed as a supplier might send it: missing-value tokens and padded cells
RAW_FEED = f"""
select product_id,
  ' ' || title || chr(160) as title,
  category,
  case when k % 10 = 0 then 'N/A' when k % 10 = 1 then ' NA ' when k % 10 = 2 then 'None'
    else material end as material,
  case when k % 7 = 0 then chr(9) || colour || chr(10) when k % 7 = 1 then '<NA>'
    when k % 7 = 2 then 'nan' else colour end as colour,
  description,
  case when k % 11 = 0 then '#N/A N/A' when k % 11 = 1 then '-1.#IND'
    when k % 11 = 2 then 'NaN' else price end as price,
  gender, size_range, season,
  case when k % 3 = 0 then 'null' when k % 3 = 1 then 'NULL ' else keywords end as keywords,
  stock_status
from (select *, cast(substr(product_id, 2) as bigint) as k from ({FEED}) f) r
"""

#: model results for the labelled part of the feed
RESULTS = """
select 'P' || cast(doc_id as string) as product_id,
  case when doc_id % 23 = 0 then 'n/a' when doc_id % 29 = 0 then '85.7'
    when doc_id % 31 = 0 then null when doc_id % 37 = 0 then '38d'
    else cast(40 * quality + doc_id % 61 as string) end as quality_score,
  case doc_id % 6 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D'
    when 4 then 'F' else 'X' end as grade,
  case when doc_id % 5 = 0 then '' when toxic = 1 then 'Flagged wording; Vague description'
    else 'Vague description' end as issues,
  case doc_id % 4 when 0 then 'material; colour' when 1 then 'None' when 2 then 'keywords'
    else '' end as missing_attributes,
  case when doc_id % 3 = 0 then '' else 'Better title ' || cast(doc_id as string) end
    as suggested_title,
  'Better description.' as suggested_description,
  'a, b, c' as suggested_keywords,
  case doc_id % 3 when 0 then 'High' when 1 then 'medium' else 'Low' end
    as improvement_priority
from $labels
"""

_REST = """quality_score, grade, issues, missing_attributes, suggested_title,
  suggested_description, suggested_keywords, improvement_priority"""

#: results with repeated and absent ids: one, two or three per product
REPEATED_RESULTS = f"""
select product_id, {_REST}, 1 as seq from ({RESULTS}) a
union all
select product_id, '7' as quality_score, grade, issues, missing_attributes,
  'Second title' as suggested_title, suggested_description, suggested_keywords,
  improvement_priority, 2 as seq
from ({RESULTS}) b where cast(substr(product_id, 2) as bigint) % 3 = 0
union all
select case when cast(substr(product_id, 2) as bigint) % 2 = 0 then product_id end, {_REST},
  0 as seq
from ({RESULTS}) c where cast(substr(product_id, 2) as bigint) % 9 = 0
"""

#: the feed with some products twice, under one id
REPEATED_FEED = f"""
select f.*, 2 as copy from ({FEED}) f
union all
select f.*, 1 as copy from ({FEED}) f where cast(substr(product_id, 2) as bigint) % 5 = 1
union all
select cast(null as string) as product_id, title, category, material, colour, description, price,
  gender, size_range, season, keywords, stock_status, 3 as copy
from ({FEED}) f where cast(substr(product_id, 2) as bigint) % 50 = 2
"""

#: raw answers for batches of eight documents: fenced, with trailing text, no array,
#: absent keys, empty lists, prose, and batches that were never asked again
ANSWERS = """
with j as (
  select (doc_id - doc_id % 8) / 8 as bd, doc_id,
    '{"product_id":"P' || cast(doc_id as string) || '","quality_score":'
    || cast(doc_id % 101 as string)
    || ',"grade":"B","issues":["x","y"],"missing_attributes":[],"suggested_title":null,'
    || '"suggested_description":"d","suggested_keywords":"k"'
    || case when doc_id % 97 = 5 then '' else ',"improvement_priority":"Low"' end
    || '}' as o
  from $documents),
b as (
  select cast(bd as bigint) as batch_id, count(*) as n, concat_ws(',',
    max(case when doc_id % 8 = 0 then o end), max(case when doc_id % 8 = 1 then o end),
    max(case when doc_id % 8 = 2 then o end), max(case when doc_id % 8 = 3 then o end),
    max(case when doc_id % 8 = 4 then o end), max(case when doc_id % 8 = 5 then o end),
    max(case when doc_id % 8 = 6 then o end), max(case when doc_id % 8 = 7 then o end))
    as body
  from j group by 1)
select batch_id, n, cast(1 as int) as attempt,
  case batch_id % 5 when 0 then '```json ' || '[' || body || ']' || ' ```'
    when 1 then '[' || body || '] done' when 2 then '{"r":1}'
    else '[' || body || ']' end as raw from b
union all
select batch_id, n, cast(2 as int),
  case batch_id % 10 when 1 then '[' || body || ']' when 6 then '[]' when 2 then 'sorry'
    else '[' || body || ']' end
from b where batch_id % 5 in (1, 2)
"""

TABLES = ("documents", "labels", "part")


def for_oracle(statement: str) -> str:
    return Template(statement).substitute({name: name for name in TABLES})


def on_spark(spark: SparkSession, folder: str, statement: str) -> DataFrame:
    files = {name: f"parquet.`{folder.rstrip('/')}/{name}.parquet`" for name in TABLES}
    return spark.sql(Template(statement).substitute(files))

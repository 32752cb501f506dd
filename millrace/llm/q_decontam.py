"""op7: test items contained in documents, all items against all documents."""

from .common import table
from .decontam import contained_items


def op7_contained_items(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_contained_items": op7_contained_items}

ORACLES = {
    "op7_contained_items": r"""
with words as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') from benchmark
), widths as (
  select distinct least(5, len(ws)) as width from words where kind = 'i' and len(ws) > 0
), doc_shingles as (
  select distinct id as doc_id, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) as shingle
  from words, widths where kind = 'd'
), item_shingles as (
  select distinct id as item_id, least(5, len(ws)) as width, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) as shingle
  from words where kind = 'i' and len(ws) > 0
), sizes as (
  select item_id, count(*) as n_item from item_shingles group by item_id
)
select doc_id, item_id, n_item, count(*) as n_found, round(count(*)::double / n_item, 6) as containment
from doc_shingles join item_shingles using (width, shingle) join sizes using (item_id)
group by doc_id, item_id, n_item
having count(*)::double / n_item >= 0.8 - 1e-12
""",
}

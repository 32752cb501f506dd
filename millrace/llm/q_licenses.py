"""op3: licences of all documents, laid out as files of a tree by source and doc_id."""

from pyspark.sql import functions as F

from .common import table
from .licenses import COMMENT, LICENSE_FILE, PARAGRAPHS, PASSAGES, RESERVED, SPDX, SPDX_TAIL, TEMPLATES, THRESHOLD, TRIGGER, WORD, scan_licenses, template_terms

#: The documents have no paths: each twentieth is taken as its directory's licence file, the others as its texts.
PATH = "concat(source, '/', cast(floor(doc_id / 400) as bigint), '/', case when doc_id % 400 = 0 then '' else concat(cast(floor(doc_id / 20) as bigint), '/') end, case when doc_id % 20 = 0 then concat('LICENSE.', doc_id) else concat(doc_id, '.txt') end)"


def op3_license_scan(spark, sf_dir):
    out = scan_licenses(table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), "text"))
    doc_id = F.regexp_extract("path", r"([0-9]+)(\.txt)?$", 1).cast("long")
    return out.select(doc_id.alias("doc_id"), "path", "own_license", "score", "license", "inherited_from")


QUERIES = {"op3_license_scan": op3_license_scan}


def _oracle() -> str:
    terms, unknown = template_terms()
    values = ", ".join(f"('{w}', {t}, {i!r}, {x!r})" for w, t, i, x in terms)
    names = ", ".join(f"'{n}'" for n, _ in TEMPLATES)
    path = PATH.replace("concat('LICENSE.', doc_id)", "concat('LICENSE.', doc_id::varchar)")
    return rf"""
with terms(word, template, idf, weight) as (values {values}),
files as (select doc_id, text, {path} as path from documents),
named as (select path, coalesce(text, '') as t, regexp_matches(split_part(path, '/', -1), '{LICENSE_FILE}') as whole from files),
passages as (
  select distinct path, passage from (
    select path, unnest(list_filter(
      regexp_split_to_array(t, '{PASSAGES}')
      || regexp_split_to_array(list_aggregate(list_transform(string_split(t, chr(10)), lambda x: case when regexp_matches(x, '{COMMENT}') then ' ' || regexp_replace(x, '{COMMENT}', '') else chr(1) end), 'string_agg', ''), chr(1))
      || case when whole then regexp_split_to_array(t, '{PARAGRAPHS}') else []::varchar[] end, lambda p: regexp_matches(p, '{TRIGGER}'))) as passage from named
    union all
    select path, t from named where whole
  )
), bag as (
  select path, passage, word, count(*) as tf from (select path, passage, unnest(regexp_split_to_array(lower(passage), '{WORD}')) as word from passages) where word <> '' group by all
), sized as (
  select path, passage, sqrt(sum(pow(tf * coalesce(idf, {unknown!r}), 2))) as size from bag left join (select distinct word, idf from terms) using (word) group by all
), dots as (
  select path, passage, template, sum(tf * idf * weight) as dot from bag join terms using (word) group by all
), near as (
  select path, round(dot / size, 6) as score, ([{names}])[template + 1] as license from dots join sized using (path, passage)
), own as (
  select path, license, score from (
    select path, license, score, case when license = '{RESERVED}' then 2 else 1 end as rank from near where score >= {THRESHOLD}
    union all
    select path, regexp_replace(id, '{SPDX_TAIL}', ''), 1.0, 0 from (select path, unnest(regexp_extract_all(t, '{SPDX}', 1)) as id from named)
  ) qualify row_number() over (partition by path order by rank, score desc, license) = 1
), dirs as (
  select dir, license as dir_license from (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, * from own where regexp_matches(split_part(path, '/', -1), '{LICENSE_FILE}'))
  qualify row_number() over (partition by dir order by license = '{RESERVED}', score desc, license) = 1
), nearest as (
  select path, dir, dir_license from (
    select path, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) as dir from files where path not in (select path from own)
  ) join dirs using (dir) qualify row_number() over (partition by path order by length(dir) desc) = 1
)
select doc_id, f.path, o.license as own_license, o.score, coalesce(o.license, n.dir_license) as license, n.dir as inherited_from
from files f left join own o on f.path = o.path left join nearest n on f.path = n.path
"""


ORACLES = {"op3_license_scan": _oracle()}

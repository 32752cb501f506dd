"""op2: every page as a WARC record in ZIP packages, read back by byte ranges."""

from .common import new_folder, table
from .warc_zip import REVISIT_BYTES, round_trip


def op2_warc_zip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


QUERIES = {"op2_warc_zip": op2_warc_zip}

ORACLES = {
    "op2_warc_zip": f"""
with p as (
  select page_id, coalesce(html, '') as payload, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), q as (
  select page_id, payload_bytes::bigint as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by payload) as last from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {REVISIT_BYTES} and page_id < last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and page_id < last then last end as refers_to
from q
""",
}

"""Named queries over the driver tables and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import text as T
from ..functions import url as U
from ..operators import admission as A
from ..operators import crawl as C
from ..operators import paths as P
from ..operators import report as R
from ..operators import scan as N
from ..operators import secrets as S
from ..sources import seeds as seed_sources
from . import duck as D
from . import samples

QUERIES: dict = {}
ORACLES: dict = {}
DOMAINS = ["example.com", "example.net"]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.expr(samples.PAGE_TEXT).alias("content"))


def _literals(spark, sf_dir: str) -> DataFrame:
    lits = F.array_distinct(T.path_literals(F.col("content")))
    return _pages(spark, sf_dir).select("page_id", F.explode(lits).alias("path"))


# ------------------------------------------------------------------ paths


@query("path_extract", f"with {D.literals()} select page_id, path from lits")
def path_extract(spark, sf_dir):
    return _literals(spark, sf_dir)


@query("path_count_by_page", f"with {D.literals()} select page_id, count(*) as n_paths from lits where {D.valid('path')} group by page_id")
def path_count_by_page(spark, sf_dir):
    kept = F.filter(F.array_distinct(T.path_literals(F.col("content"))), T.is_valid_path)
    return _pages(spark, sf_dir).select("page_id", F.size(kept).cast("long").alias("n_paths")).where("n_paths > 0")


@query("path_clean_binary", f"select page_id, length(c)::bigint as n_chars, md5(c) as digest from (select page_id, {D.cleaned(samples.PAGE_TEXT)} as c from pages)")
def path_clean_binary(spark, sf_dir):
    c = T.clean_binary(F.col("content"))
    return _pages(spark, sf_dir).select("page_id", c.alias("c")).select("page_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


def _flag(name: str, sql: str, f) -> None:
    """A predicate on every distinct literal."""

    def run(spark, sf_dir):
        return _literals(spark, sf_dir).select("page_id", "path", f(F.col("path")).alias("flag"))

    QUERIES[name] = run
    ORACLES[name] = f"with {D.literals()} select page_id, path, {sql} as flag from lits"


_flag("path_valid", D.valid("path"), T.is_valid_path)
_flag("path_ext_blacklist", D.file_extension("path"), T.has_file_extension)
_flag("path_static_blacklist", D.static("path"), T.has_static_segment)
_flag("path_download_params", D.download_param("path"), T.has_download_param)
_flag("path_inline_base64", D.inline_base64("path"), T.has_inline_base64)
_flag("path_zero_width", D.zero_width("path"), T.has_zero_width)
_flag("path_nonascii_ratio", f"{D.non_ascii('path')} > 0.3", lambda p: T.non_ascii_share(p) > 0.3)
_flag("path_control_chars", D.control("path"), T.has_control)
_flag("path_private_use", D.private_use("path"), T.has_private_use)
_flag("path_char_dominance", f"({D.top_share('path')} > 0.4)", lambda p: T.top_char_share(p) > 0.4)
_flag("path_repeats", D.repetitive("path"), T.is_repetitive)
_flag("path_binary_like", D.binary_like("path"), T.is_binary_like)
_flag("url_is_js_strict", D.js("path"), U.is_js_strict)
_flag("url_is_js_loose", "(ends_with(lower(path), '.js') or contains(lower(path), '.js?') or contains(lower(path), 'javascript'))", U.is_js_loose)
_flag("domain_allowlist", D.allowed("path", DOMAINS), lambda p: U.is_allowed_domain(p, U.parse_domains("example.com, example.net")))


def _chain(profile: str, domains: list[str] | None = None):
    def run(spark, sf_dir):
        return P.extract_paths(_pages(spark, sf_dir), profile=profile, domains=domains).select("page_id", F.explode("paths").alias("path"))

    return run


for _profile in ("deep", "head"):
    QUERIES[f"path_full_chain_{_profile}"] = _chain(_profile)
    ORACLES[f"path_full_chain_{_profile}"] = f"with {D.literals()} {D.admitted('page_id', 'lits', _profile)}"
QUERIES["path_full_chain_domains"] = _chain("deep", DOMAINS)
ORACLES["path_full_chain_domains"] = f"with {D.literals()} {D.admitted('page_id', 'lits', 'deep', DOMAINS)}"


# ------------------------------------------------------------------ seeds and URLs


def _seeds(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.expr(samples.SEED_URL).alias("url"))


SEEDS = f"seeds as (select page_id, {samples.SEED_URL} as url from pages)"


def _url(name: str, out: str, sql: str, f) -> None:
    def run(spark, sf_dir):
        return _seeds(spark, sf_dir).select("page_id", "url", f(F.col("url")).alias(out))

    QUERIES[name] = run
    ORACLES[name] = f"with {SEEDS} select page_id, url, {sql} as {out} from seeds"


_url("url_clean", "cleaned", D.clean_url("url"), U.clean_url)
_url("url_parsable", "parsable", D.parsable("url"), U.is_parsable)
_url("url_host", "host", D.host("url"), U.host_of)
_url("url_extension", "extension", D.extension("url"), U.extension_of)


@query("url_scheme_filter", f"with {SEEDS}, c as (select page_id, {D.clean_url('url')} as url from seeds) select page_id, url from c where url <> '' and {D.parsable('url')} and {D.scheme('url')} in ('http', 'https')")
def url_scheme_filter(spark, sf_dir):
    return N.normalised_seeds(_seeds(spark, sf_dir))


@query("url_resolve_child", f"with {D.literals()}, b as (select page_id, path, 'https://h.example/dir' || page_id || '/app.js' as base from lits) select page_id, path, {D.resolve('base', 'path')} as child from b")
def url_resolve_child(spark, sf_dir):
    base = F.concat(F.lit("https://h.example/dir"), F.col("page_id").cast("string"), F.lit("/app.js"))
    return _literals(spark, sf_dir).select("page_id", "path", U.resolve_child(base, F.col("path")).alias("child"))


@query(
    "url_child_scripts",
    f"""with {D.literals()}, a as ({D.admitted('page_id', 'lits', 'head')}), b as (select page_id, {D.clean_url('path')} as path, 'https://h.example/dir' || page_id || '/app.js' as base from a),
c as (select page_id, {D.resolve('base', 'path')} as u from b where path <> '' and {D.js('path')}), d as (select page_id, {D.clean_url('u')} as child from c)
select distinct page_id, child from d where child <> '' and {D.parsable('child')} and {D.scheme('child')} in ('http', 'https')""",
)
def url_child_scripts(spark, sf_dir):
    base = F.concat(F.lit("https://h.example/dir"), F.col("page_id").cast("string"), F.lit("/app.js"))
    return P.extract_paths(_pages(spark, sf_dir), profile="head").select("page_id", F.explode(U.child_scripts(base, F.col("paths"))).alias("child"))


LINES = "concat(case page_id % 4 when 0 then '# ' when 1 then ' ' when 2 then '' else chr(9) end, case when page_id % 5 = 0 then '' else url end, case page_id % 3 when 0 then ' ' else '' end)"


@query("seed_lines", f"select line as url, count(*) as n from (select {D.trim(LINES)} as line from pages) where line <> '' and not starts_with(line, '#') group by line")
def seed_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "pages").select(F.expr(LINES).alias("value"))
    return seed_sources.from_lines(lines).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("seed_union", "select 0 as part, url from pages union all select 1, url from pages where page_id % 3 = 0 union all select 2, 'https://h.example/one'")
def seed_union(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    one = seed_sources.from_urls(spark, ["https://h.example/one"])
    return seed_sources.union(pages.select("url"), pages.where("page_id % 3 = 0").select("url"), one).select("part", "url")


# ------------------------------------------------------------------ admission


def _fetches(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", *[F.expr(e).alias(n) for n, e in samples.FETCH.items()])


FETCHES = "fetches as (select page_id, " + ", ".join(f"{e} as {n}" for n, e in samples.FETCH.items()) + " from pages)"


def _fetch(name: str, out: str, sql: str, f) -> None:
    def run(spark, sf_dir):
        return _fetches(spark, sf_dir).select("page_id", f().alias(out))

    QUERIES[name] = run
    ORACLES[name] = f"with {FETCHES} select page_id, {sql} as {out} from fetches"


_fetch("fetch_ext_skip", "flag", f"list_contains({D.texts(D.fixed.FETCH_EXTENSIONS)}, {D.extension('url')})", lambda: U.has_blocked_extension(F.col("url")))
_fetch("fetch_url_pattern_skip", "flag", D.binary_url("url"), lambda: U.looks_binary(F.col("url")))
_fetch("fetch_content_type_skip", "flag", D.blocked_type("content_type"), lambda: A.is_blocked_type(F.col("content_type")))
_fetch("fetch_attachment_skip", "flag", D.download("content_disposition"), lambda: A.is_download(F.col("content_disposition")))
_fetch("fetch_length_skip", "flag", "length(content_length) > 8", lambda: A.is_too_large(F.col("content_length")))
_fetch("fetch_magic", "flag", D.signature("body"), lambda: T.has_signature(F.col("body")))
_fetch("fetch_binary_ratio", "share", f"round({D.binary_share('body')}, 6)", lambda: F.round(T.binary_share(F.col("body")), 6))

REASON = f"""case when list_contains({D.texts(D.fixed.FETCH_EXTENSIONS)}, {D.extension('url')}) then 'skipped: blacklisted file extension'
  when {D.binary_url('url')} then 'skipped: suspicious binary URL pattern'
  when {D.blocked_type('content_type')} then 'skipped: blacklisted content-type: ' || content_type
  when status <> 200 then null
  when {D.download('content_disposition')} then 'skipped: binary file download detected'
  when length(content_length) > 8 then 'skipped: file too large'
  when {D.signature('body')} or {D.binary_share('body')} > 0.3 then 'skipped: binary content detected' end"""
ERROR = "case when reason is null and status = 404 then 'HTTP 404: 404 Not Found' when reason is null and status = 500 then 'HTTP 500: 500 Internal Server Error' else '' end"


@query("fetch_skip_reason", f"with {FETCHES}, r as (select *, {REASON} as reason from fetches) select url, reason as skip_reason, {ERROR} as error, reason is not null as skipped from r")
def fetch_skip_reason(spark, sf_dir):
    out = A.admit(_fetches(spark, sf_dir).withColumn("body", F.encode("body", "UTF-8")).withColumn("error", F.lit("")))
    return out.select("url", "skip_reason", "error", "skipped")


# ------------------------------------------------------------------ secrets


def _secret_docs(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(samples.SECRET_TEXT).alias("content"))


def _secrets(kinds: str, pack: str):
    def run(spark, sf_dir):
        return S.scan_secrets(_secret_docs(spark, sf_dir), pack=pack, kinds=kinds)

    return run


for _kinds, _pack in (("irregular", "compat"), ("keyword", "compat"), ("irregular", "intended"), ("keyword", "intended")):
    QUERIES[f"secrets_{_kinds}_{_pack}"] = _secrets(_kinds, _pack)
    ORACLES[f"secrets_{_kinds}_{_pack}"] = f"with {D.secret_ctes(_pack, _kinds)} select doc_id, rule_ord, match_ord, match from found"

LABELLED = f"with {D.secret_ctes('compat', 'all')}, {D.label_ctes('compat')}"
DISTINCT = "firsts_of as (select doc_id, rendered, label, min((rule_ord, match_ord)) as first from labelled where octet_length(encode(rendered)) between 5 and 1000 group by all)"


@query("secrets_classified", f"{LABELLED} select doc_id, rule_ord, match_ord, match, label, rendered from labelled")
def secrets_classified(spark, sf_dir):
    return S.label_secrets(S.scan_secrets(_secret_docs(spark, sf_dir)))


@query("secrets_dedup", f"{LABELLED}, {DISTINCT} select doc_id, (row_number() over (partition by doc_id order by first) - 1)::int as place, rendered from firsts_of")
def secrets_dedup(spark, sf_dir):
    return _secret_docs(spark, sf_dir).select("doc_id", F.posexplode(S.distinct_secrets(F.coalesce("content", F.lit("")))).alias("place", "rendered"))


@query("secrets_by_label", f"{LABELLED}, {DISTINCT} select label, count(*) as n, count(distinct doc_id) as n_docs from firsts_of group by label")
def secrets_by_label(spark, sf_dir):
    found = S.scan_secrets(_secret_docs(spark, sf_dir)).select("doc_id", "match").distinct()
    found = S.label_secrets(found).where(S.is_valid_secret(F.col("rendered")))
    return found.select("doc_id", "label", "rendered").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


TURNS = "(select conv_id * 1000 + turn as doc_id, text from conversations)"


@query("secrets_in_conversations", f"with {D.secret_ctes('intended', 'all', TURNS)} select doc_id, rule_ord, match_ord, match from found")
def secrets_in_conversations(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn("doc_id", F.expr("conv_id * 1000 + turn")).select("doc_id", F.expr(samples.SECRET_TEXT).alias("content"))
    return S.scan_secrets(turns, pack="intended")


# ------------------------------------------------------------------ crawl


def _graph(spark, sf_dir: str) -> DataFrame:
    """Page i links to 2i + 1 and 2i + 2 and back to its parent."""
    body = "concat('<script src=', chr(34), '/p', 2 * page_id + 1, '.js', chr(34), '></script> ', chr(39), 'https://h.example/p', 2 * page_id + 2, '.js', chr(39), ' ', chr(34), '/p', cast(floor((page_id - 1) / 2) as bigint), '.js', chr(34))"
    pages = _table(spark, sf_dir, "pages").select(F.expr("concat('https://h.example/p', page_id, '.js')").alias("url"), F.expr(body).alias("body"))
    return pages.select("url", F.lit(200).alias("status"), F.lit("").alias("content_type"), F.lit("").alias("content_disposition"), F.lit("").alias("content_length"), F.encode("body", "UTF-8").alias("body"), F.lit("").alias("error"))


def _crawled(spark, sf_dir: str, depth: int = 3) -> DataFrame:
    seeds = seed_sources.from_urls(spark, ["https://h.example/p0.js", "https://h.example/p5.js", "https://h.example/p0.js"])
    return C.crawl(seeds, _graph(spark, sf_dir), max_depth=depth)


BFS = """recursive edges as (
  select 'https://h.example/p' || page_id || '.js' as parent, 'https://h.example/p' || unnest([2 * page_id + 1, 2 * page_id + 2, (floor((page_id - 1) / 2.0))::bigint]) || '.js' as child from pages
), links as (select * from edges), reach(url, depth) as (
  select * from (values ('https://h.example/p0.js', 0), ('https://h.example/p5.js', 0)) union select child, depth + 1 from reach join links on parent = url where depth < 3
), least_depth as (select url, min(depth) as depth from reach group by url)"""


@query("crawl_bfs_depth", f"with {BFS} select url, depth from least_depth")
def crawl_bfs_depth(spark, sf_dir):
    return _crawled(spark, sf_dir).select("url", "depth")


@query("crawl_parent", f"with {BFS} select l.url, coalesce(min(p.url), '') as parent_url from least_depth l left join (select child, d.url, d.depth from links join least_depth d on parent = d.url) p on p.child = l.url and p.depth = l.depth - 1 group by l.url")
def crawl_parent(spark, sf_dir):
    return _crawled(spark, sf_dir).select("url", "parent_url")


@query("crawl_visited", f"with {BFS} select depth, count(*) as n, count(*) - count(page_id) as n_failed from least_depth l left join pages p on l.url = 'https://h.example/p' || page_id || '.js' group by depth")
def crawl_visited(spark, sf_dir):
    return _crawled(spark, sf_dir).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") != "").alias("n_failed"))


# ------------------------------------------------------------------ results and reports


def _results(spark, sf_dir: str) -> DataFrame:
    fetches = _fetches(spark, sf_dir).withColumn("body", F.encode(F.concat("body", F.expr("concat(' ', chr(34), '/api/u', page_id, chr(34), ' AKIA', upper(substr(md5(cast(page_id as varchar(20))), 1, 16)))")), "UTF-8")).withColumn("error", F.lit(""))
    return N.scan_fetched(fetches)


BODY = "body || concat(' ', chr(34), '/api/u', page_id, chr(34), ' AKIA', upper(substr(md5(cast(page_id as varchar(20))), 1, 16)))"
RESULTS = f"""{FETCHES}, r as (select * exclude (body), {BODY} as body from (select *, {REASON} as reason from fetches)),
results as (select page_id, url, reason, {ERROR} as error, body from r), good as (select page_id, body from results where reason is null and error = ''),
{D.literals('good', 'page_id', 'body')}, admitted as ({D.admitted('page_id', 'lits')}),
{D.secret_ctes('compat', 'all', 'good', 'page_id', 'body')}, {D.label_ctes('compat', 'page_id')},
secrets as (select distinct page_id, rendered from labelled where octet_length(encode(rendered)) between 5 and 1000)"""


@query("scan_results", f"with {RESULTS} select url, coalesce(n_paths, 0)::int as path_count, coalesce(n_secrets, 0)::int as secret_count, {D.js('url')} as is_js_file, error, reason is not null as skipped, reason as skip_reason from results left join (select page_id, count(*) as n_paths from admitted group by page_id) using (page_id) left join (select page_id, count(*) as n_secrets from secrets group by page_id) using (page_id)")
def scan_results(spark, sf_dir):
    return _results(spark, sf_dir).select("url", "path_count", "secret_count", "is_js_file", "error", "skipped", "skip_reason")


@query("report_summary", f"with {RESULTS} select count(*) as total_urls, count(*) filter (error = '' and reason is null) as successful_scans, count(*) filter (error <> '') as failed_scans, count(*) filter (error = '' and reason is not null) as skipped_scans, count(*) filter (error = '') as successful_incl_skipped, (select count(*) from admitted) as total_paths, (select count(*) from secrets) as total_secrets from results")
def report_summary(spark, sf_dir):
    return R.summarise(_results(spark, sf_dir))


@query("report_txt_listing", f"with {RESULTS} select distinct 0 as section, line from (select url as line from results where error = '' union all select path from admitted where {D.absolute('path')}) union all select distinct 1, path from admitted where starts_with(path, '/')")
def report_txt_listing(spark, sf_dir):
    return R.listing(_results(spark, sf_dir))


# ------------------------------------------------------------------ headers and display

RAW_HEADER = "concat(case page_id % 6 when 0 then 'Cookie: ' when 1 then ' X-Api-Key :' when 2 then 'Accept:' when 3 then 'NoColon ' when 4 then 'Authorization: Bearer ' else 'x-session-token:' end, substr(url, 1, page_id % 40), case when page_id % 4 = 0 then ': b ' else '' end)"
PAIRS = f"raws as (select page_id, {RAW_HEADER} as raw from pages), pairs as (select page_id, {D.trim('split_part(raw, chr(58), 1)')} as name, {D.trim('substr(raw, instr(raw, chr(58)) + 1)')} as value from raws where contains(raw, ':'))"


def _headers(spark, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "pages").select("page_id", F.expr(RAW_HEADER).alias("raw"))
    return raw.select("page_id", F.explode(H.parse_headers(F.array("raw"))).alias("name", "value"))


@query("header_parse", f"with {PAIRS} select page_id, name, value from pairs")
def header_parse(spark, sf_dir):
    return _headers(spark, sf_dir)


SENSITIVE = D.has_any("lower(name)", D.fixed.SENSITIVE_HEADERS)


@query("header_mask", f"with {PAIRS} select page_id, name, case when {SENSITIVE} then case when length(value) <= 8 then repeat('*', length(value)) else substr(value, 1, 4) || repeat('*', length(value) - 8) || substr(value, length(value) - 3) end else value end as shown from pairs")
def header_mask(spark, sf_dir):
    return _headers(spark, sf_dir).select("page_id", "name", H.mask_header(F.col("name"), F.col("value")).alias("shown"))


@query("display_truncate", "select page_id, case when length(u) <= 70 then u else substr(u, 1, 67) || '...' end as shown from (select page_id, url || repeat('/x', (page_id % 40)::int) as u from pages)")
def display_truncate(spark, sf_dir):
    u = F.expr("concat(url, repeat('/x', cast(page_id % 40 as int)))")
    return _table(spark, sf_dir, "pages").select("page_id", H.shorten(u, 70).alias("shown"))


@query("display_secret", f"{LABELLED} select distinct rendered, upper(label) || ': ' || case when octet_length(encode(v)) > 50 then substr(v, 1, list_max(list_filter(range(0, 48), lambda n: octet_length(encode(substr(v, 1, n))) <= 47))) || '...' else v end as shown from (select *, case when label = 'Unknown Secret' then match else ' ' || match end as v from labelled)")
def display_secret(spark, sf_dir):
    found = S.label_secrets(S.scan_secrets(_secret_docs(spark, sf_dir)))
    return found.select("rendered", H.format_secret(F.col("rendered")).alias("shown")).distinct()


@query("size_format", "select page_id, case when n > 1048576 then format('{:.1f}MB', n / 1048576.0) when n > 1024 then format('{:.1f}KB', n / 1024.0) else n || 'B' end as shown from (select page_id, (length(html) * case page_id % 3 when 0 then 1 when 1 then 1000 else 0 end + page_id)::bigint as n from pages)")
def size_format(spark, sf_dir):
    n = F.expr("length(html) * case page_id % 3 when 0 then 1 when 1 then 1000 else 0 end + page_id").cast("long")
    return _table(spark, sf_dir, "pages").select("page_id", H.format_size(n).alias("shown"))

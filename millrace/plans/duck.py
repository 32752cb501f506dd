"""DuckDB SQL for the named queries. It is written apart from the Spark expressions: list tests instead of joined patterns."""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import BINARY_RUN, DEEP_PATH, HEAD_PATH, INLINE_DATA, LITERAL, LONG_BASE64
from ..functions.url import UNICODE_SPACE
from ..operators.rules import UNKNOWN, cases, rules
from . import samples


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def texts(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def has_any(c: str, values: list[str]) -> str:
    return f"len(list_filter({texts(values)}, lambda v: contains({c}, v))) > 0"


def starts_any(c: str, values: list[str]) -> str:
    return f"len(list_filter({texts(values)}, lambda v: starts_with({c}, v))) > 0"


def bytes_of(c: str) -> str:
    return f"octet_length(encode({c}))"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+$', '', 'g')"


def clean_url(c: str) -> str:
    t = trim(rf"regexp_replace({c}, '\\+$', '')")
    return f"case when {t} in ('http://', 'https://') then '' else {t} end"


def scheme(c: str) -> str:
    return f"lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def rest(c: str) -> str:
    return rf"regexp_extract(split_part(split_part({c}, '#', 1), '?', 1), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?([\s\S]*)', 1)"


def host_port(c: str) -> str:
    return rf"regexp_extract(regexp_extract({rest(c)}, '^//([^/]*)', 1), '([^@]*)$', 1)"


def host(c: str) -> str:
    return rf"regexp_replace(regexp_replace({host_port(c)}, ':[0-9]*$', ''), '^\[|\]$', '', 'g')"


def path(c: str) -> str:
    return f"regexp_replace({rest(c)}, '^//[^/]*', '')"


def bad_escape(c: str) -> str:
    return f"contains(regexp_replace({c}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')"


def parsable(c: str) -> str:
    h = host_port(c)
    return rf"""not (regexp_matches({c}, '[\x00-\x1F\x7F]') or starts_with({c}, ':')
      or ({scheme(c)} = '' and not starts_with({c}, '/') and contains(regexp_extract({rest(c)}, '^([^/]*)', 1), ':'))
      or {bad_escape(path(c))} or {bad_escape(rf"regexp_extract({c}, '#([\s\S]*)', 1)")}
      or regexp_matches({h}, '[^A-Za-z0-9_.~!$&''()*+,;=:<>"\[\]\x{{80}}-\x{{10FFFF}}-]')
      or (not starts_with({h}, '[') and regexp_matches({h}, ':[0-9]*[^0-9:][^:]*$'))
      or (starts_with({h}, '[') and not regexp_matches({h}, '^\[[^\]]*\](:[0-9]*)?$')))"""


def js(c: str) -> str:
    return rf"regexp_matches({c}, '\.js(\?.*)?$')"


def absolute(c: str) -> str:
    return f"(starts_with({c}, 'http://') or starts_with({c}, 'https://'))"


def resolve(base: str, p: str) -> str:
    root = f"{scheme(base)} || '://' || {host_port(base)}"
    return f"case when {absolute(p)} then {p} when starts_with({p}, '/') then {root} || {p} else {root} || regexp_replace({path(base)}, '/$', '') || '/' || {p} end"


def allowed(c: str, domains: list[str]) -> str:
    ends = " or ".join(f"ends_with({host(c)}, {text(d)})" for d in domains)
    return f"(starts_with({c}, '/') or starts_with({c}, './') or starts_with({c}, '../') or ({parsable(c)} and ({host(c)} = '' or {ends})))"


def extension(c: str) -> str:
    bare = f"regexp_replace(split_part(split_part({c}, '?', 1), '#', 1), '/+$', '')"
    return rf"lower(regexp_extract({bare}, '(\.[^./]*)$', 1))"


def binary_url(c: str) -> str:
    return f"({starts_any(f'lower({c})', fixed.DATA_PREFIXES)} or {has_any(f'lower({c})', fixed.BINARY_URL_PARTS)} or {has_any(f'lower({c})', fixed.BINARY_URL_PARAMS)})"


def blocked_type(c: str) -> str:
    main = f"lower(trim(split_part({c}, ';', 1)))"
    return f"({main} <> '' and not {starts_any(main, fixed.ALLOWED_TYPES)} and {starts_any(main, fixed.BLOCKED_TYPES)})"


def download(c: str) -> str:
    return f"(contains(lower({c}), 'attachment') and not {has_any(f'lower({c})', fixed.TEXT_ATTACHMENTS)})"


def signature(c: str) -> str:
    return f"({bytes_of(c)} >= 4 and {starts_any(f'hex(encode(substr({c}, 1, 4)))', fixed.SIGNATURES)})"


def binary_share(c: str) -> str:
    """Of texts whose first 2000 bytes are counted as their hexadecimal pairs."""
    pairs = f"list_transform(range(0, least({bytes_of(c)}, 2000)), lambda i: substr(hex(encode(substr({c}, 1, 2000))), 2 * i + 1, 2))"
    odd = [f"{b:02X}" for b in [*range(9), *range(14, 32), 127]]
    return f"case when {bytes_of(c)} < 100 then 0.0 else len(list_filter({pairs}, lambda x: list_contains({texts(odd)}, x)))::double / least({bytes_of(c)}, 2000) end"


def cleaned(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, {text(INLINE_DATA)}, '', 'g'), {text(LONG_BASE64)}, '', 'g'), {text(BINARY_RUN)}, '', 'g')"


def literals(source: str = "pages", key: str = "page_id", content: str = samples.PAGE_TEXT) -> str:
    """Common table expression ``lits``: the distinct literals of each row."""
    return f"lits as (select distinct {key}, {trim('p')} as path from (select {key}, unnest(regexp_extract_all({cleaned(content)}, {text(LITERAL)}, 1)) as p from {source}))"


def valid(p: str) -> str:
    return f"({bytes_of(p)} between 2 and 2000 and {starts_any(p, ['http://', 'https://', '/', './', '../'])} and regexp_matches({p}, '[a-zA-Z0-9]'))"


def file_extension(p: str) -> str:
    low = f"lower({p})"
    return f"(len(list_filter({texts(fixed.PATH_EXTENSIONS)}, lambda e: ends_with({low}, e) or contains({low}, e || '?'))) > 0)"


def static(p: str) -> str:
    return f"({has_any(f'lower({p})', fixed.STATIC_SEGMENTS)})"


def download_param(p: str) -> str:
    return f"({has_any(f'lower({p})', fixed.DOWNLOAD_PARAMS)})"


def inline_base64(p: str) -> str:
    return f"(contains(lower({p}), ';base64,') and {bytes_of(p)} > 100)"


def zero_width(p: str) -> str:
    return rf"regexp_matches({p}, '[\x00\x{{FEFF}}\x{{200B}}\x{{200C}}\x{{200D}}]')"


def non_ascii(p: str) -> str:
    return rf"length(regexp_replace({p}, '[\x00-\x7F]', '', 'g'))::double / length({p})"


def control(p: str) -> str:
    return rf"regexp_matches(regexp_replace({p}, '[\t\n\r]', '', 'g'), '\p{{Cc}}')"


def private_use(p: str) -> str:
    ends = "".join(rf"\x{{{n:X}FFFE}}\x{{{n:X}FFFF}}" for n in range(1, 17))
    return rf"regexp_matches({p}, '[\x{{E000}}-\x{{F8FF}}\x{{F0000}}-\x{{FFFFD}}\x{{100000}}-\x{{10FFFD}}\x{{FDD0}}-\x{{FDEF}}\x{{FFFE}}\x{{FFFF}}{ends}]')"


def top_share(p: str) -> str:
    return f"list_max(list_transform(list_distinct(string_split({p}, '')), lambda ch: length({p}) - length(replace({p}, ch, ''))))::double / length({p})"


def repetitive(p: str) -> str:
    return f"({bytes_of(p)} >= 10 and ({top_share(p)} > 0.4 or {has_any(p, fixed.RUNS)} or ({bytes_of(p)} > 20 and {has_any(f'lower({p})', fixed.ALTERNATIONS)})))"


def base64_like(p: str) -> str:
    bare = rf"regexp_replace({p}, '[= \n\r\t]', '', 'g')"
    return f"(length({bare}) >= 20 and regexp_full_match({bare}, '[A-Za-z0-9+/]*') and least(length({bare}), 100) % 4 <> 1)"


def binary_like(p: str) -> str:
    return f"({bytes_of(p)} >= 10 and (({bytes_of(p)} > 100 and {base64_like(p)}) or {has_any(p, fixed.PACKED_MARKS)}))"


def unusual(p: str) -> str:
    return f"({zero_width(p)} or {non_ascii(p)} > 0.3 or {control(p)} or {repetitive(p)} or {private_use(p)})"


def wanted(p: str) -> str:
    return f"{valid(p)} and not ({file_extension(p)} or {inline_base64(p)} or {static(p)} or {download_param(p)}) and not {unusual(p)} and not {binary_like(p)}"


def admitted(key: str, lits: str, profile: str = "deep", domains: list[str] | None = None) -> str:
    """Select of the distinct admitted paths of ``lits``."""
    limit = f" and {allowed('path', domains)}" if domains else ""
    if profile == "deep":
        return f"select distinct {key}, path from (select {key}, {clean_url('path')} as path from {lits} where {wanted('path')}) where regexp_matches(path, {text(DEEP_PATH)}){limit}"
    pattern = HEAD_PATH.replace(r"\z", "$")
    return f"select distinct {key}, path from {lits} where {wanted('path')} and regexp_matches(path, {text(pattern)}) and {valid('path')}{limit}"


def norm(c: str) -> str:
    return f"translate(lower(translate({c}, 'ſK', 'sk')), '_-', '')"


def secret_ctes(pack: str, kinds: str, source: str = "documents", key: str = "doc_id", content: str = samples.SECRET_TEXT) -> str:
    """Common table expressions up to ``found`` (key, rule_ord, match_ord, match)."""
    every = [r for r in rules(pack) if kinds == "all" or (r.anchor is None) == (kinds == "irregular")]
    values = ", ".join(f"({r.order}, {text(r.anchor or '')}, {text(r.re2)})" for r in every)
    return f"""rules(rule_ord, anchor, pattern) as (values {values}),
texts as materialized (select {key}, body, {norm('body')} as norm from (select {key}, {content} as body from {source})),
hits as (select {key}, rule_ord, regexp_extract_all(body, pattern, 0) as ms from texts join rules on anchor = '' or contains(norm, anchor)),
found as materialized (select {key}, rule_ord, (unnest(range(0, len(ms))))::int as match_ord, unnest(ms) as match from hits)"""


def label_ctes(pack: str, key: str = "doc_id") -> str:
    """Common table expressions from ``found`` to ``labelled`` with label and rendered."""
    values = ", ".join(f"({c.order}, {text(c.anchor or '')}, {text(c.re2)}, {text(c.label)})" for c in cases(pack))
    return f"""cases(case_ord, anchor, pattern, label) as (values {values}),
kinds as materialized (select distinct match, {norm('match')} as norm from found),
firsts as (select match, arg_min(label, case_ord) as label from kinds join cases on (anchor = '' or contains(norm, anchor)) and regexp_matches(match, pattern) group by match),
labelled as (select found.*, coalesce(label, '{UNKNOWN}') as label, coalesce(label || ':  ', '{UNKNOWN}: ') || match as rendered from found left join firsts using (match))"""

"""Inputs of the named queries: driver tables with literals added, so that every operator has something to find.

Each recipe is one SQL expression that Spark and DuckDB read alike; a test on whole
tables is then a test of the operators and not of the generator.
"""

from __future__ import annotations

Q2, Q1, BACKSLASH = "chr(34)", "chr(39)", "chr(92)"


def quoted(*parts: str) -> str:
    """A quoted literal from SQL expressions."""
    return ", ".join(["' '", Q2, *parts, Q2])


ID = "page_id"
LITERALS = [
    quoted("'/api/v1/users/'", ID),
    quoted("'https://cdn'", f"{ID} % 5", "'.example.com/app'", ID, "'.js?x=1'"),
    quoted("'https://notexample.com/n'", ID),
    quoted("'https://api.other.org:8443/n'", ID),
    quoted("'./rel/'", ID, "'.js'"),
    quoted("'../up/'", ID),
    quoted("'/static/app'", ID, "'.js'"),
    quoted("'/js/app'", ID, "'.js'"),
    quoted("'/pic'", ID, "'.PNG?v=2'"),
    quoted("'/feed'", ID, "'.xml'"),
    quoted("'/a'", ID, "'?export=1'"),
    quoted("'/r?format=csv&n='", ID),
    quoted("'/zip/PK'", ID, "'/entry'"),
    quoted("'/y----'", ID, "'/zz'"),
    quoted("'/run/121212/'", ID, "'/qwertyuiop'"),
    quoted("'/aaaaaaaaaaaa'", f"{ID} % 7"),
    quoted("'/für/'", f"{ID} % 3"),
    quoted("'/ééé'", f"{ID} % 3"),
    quoted("'/zero​width/'", ID),
    quoted("'/private/'", ID),
    quoted("'/'", f"repeat(md5(cast({ID} as varchar(20))), 4)"),
    quoted("'/'", "repeat('ab/cd12/', 300)", ID),
    quoted("'https://b.example.com/end'", ID, BACKSLASH),
    quoted("'data:image/png;base64,'", f"repeat(md5(cast({ID} as varchar(20))), 5)"),
    quoted("'/x;base64,'", f"repeat('q0', {ID} % 80)"),
    "' '," + Q2 + ", '/mixed/', page_id, " + Q1,
    quoted("'//cdn.example.net/lib'", ID, "'.js'"),
    quoted("'http://'", Q1),
]
#: Page text with literals of all kinds.
PAGE_TEXT = "concat(html, " + ", ".join(LITERALS) + ")"

#: Document text with planted, made-up credentials.
SECRET_TEXT = (
    "concat(text, ' AKIA', upper(substr(md5(cast(doc_id as varchar(20))), 1, 16)), ' github_token: ', chr(39), 'w-', doc_id, chr(39), "
    "case when doc_id % 3 = 0 then concat(' api_key = ', chr(34), 'my-value', doc_id, chr(34)) else '' end, "
    "case when doc_id % 5 = 0 then concat(' Bearer eyJ', doc_id, '.eyJb.c-', doc_id) else '' end, "
    "case when doc_id % 7 = 0 then concat(' sk_live_', md5(cast(doc_id as varchar(20)))) else '' end, "
    "case when doc_id % 11 = 0 then concat(' ', md5(cast(doc_id as varchar(20))), '-us', doc_id % 30) else '' end, "
    "case when doc_id % 13 = 0 then concat(' LOCAL-storage_key=w', doc_id, ' secret_sso:w- AUTH_TOKEN = ww') else '' end, "
    "case when doc_id % 17 = 0 then concat(' AIza', md5(cast(doc_id as varchar(20))), 'abc key-', md5(cast(doc_id as varchar(20)))) else '' end, "
    "case when doc_id % 19 = 0 then concat(' air_table_api_key=', chr(34), doc_id, chr(34), ' Basic ', md5(cast(doc_id as varchar(20)))) else '' end)"
)

#: Raw URLs as a user may give them.
SEED_URL = (
    "concat(case page_id % 9 when 0 then ' ' else '' end, case page_id % 8 when 0 then 'ftp://h.example/' when 1 then 'HTTP://H.example:8080/p' when 2 then 'h.example/' "
    "when 3 then 'https://u:p@h.example/a b?x=%zz#f' when 4 then 'https://h.example/%zz' when 5 then 'https://h example/' when 6 then 'https://h.example:8a/' else 'https://h.example/' end, "
    "page_id, case page_id % 6 when 0 then repeat(chr(92), 2) when 1 then '.js' when 2 then '.js?v=1' when 3 then '.JS' when 4 then '/javascript/x' else '/a.tar.gz/' end)"
)

#: Fetched resources made from pages.
FETCH = {
    "url": "concat('https://h.example/', case page_id % 12 when 0 then 'images/' when 1 then 'backup/' else '' end, 'p', page_id, case page_id % 10 when 0 then '.png?v=1' when 1 then '.ai' when 2 then '?type=pdf' when 3 then '.tar.gz' else '.html' end)",
    "status": "case when page_id % 7 = 0 then 404 when page_id % 31 = 0 then 500 else 200 end",
    "content_type": "case page_id % 9 when 0 then 'image/png' when 1 then 'Text/HTML; charset=x' when 2 then 'application/pdf' when 3 then '' when 4 then 'application/x-thing' when 5 then ' video/mp4' else 'text/html' end",
    "content_disposition": "case page_id % 13 when 0 then 'attachment; filename=a.bin' when 1 then 'Attachment; filename=a.rar' else '' end",
    "content_length": "case page_id % 17 when 0 then '100000000' when 1 then '99999999' else '1000' end",
    "body": "concat(case page_id % 19 when 0 then '%PDF-1.7' when 1 then 'GIF89a' when 2 then repeat(chr(1), 40) when 3 then repeat(chr(7), 900) else '' end, html)",
}

"""op8: the main text of every page. Tests hold the cut against brute force and pages against known articles."""

from .common import table
from .html_text import extract_text


def op8_html_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}

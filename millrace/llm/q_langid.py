"""op9: the language of every document. Learned vectors have no SQL; tests measure held-out accuracy."""

from .common import table
from .langid import language_id


def op9_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language_id": op9_language_id}

"""op6: robust outliers over all documents. The estimate is iterative, so there is no SQL; tests hold it against brute force."""

from .common import table
from .quality import quality_rules


def op6_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}

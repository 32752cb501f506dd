"""op1: toxicity scores of all documents, learned from two thirds of the labels. Tests hold the search against brute force."""

from pyspark.sql import functions as F

from .common import table
from .toxicity import toxicity


def op1_toxicity(spark, sf_dir):
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.col("neighbours.doc_id").alias("nearest"))


QUERIES = {"op1_toxicity": op1_toxicity}

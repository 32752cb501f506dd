"""op10: all documents tokenised, packed, written as binary shards and read back, piece by piece."""

from pyspark.sql import functions as F

from .common import new_folder, table, written
from .packing import packed, read_pieces, write_matrices


def op10_pack_tokens(spark, sf_dir):
    folder = new_folder(spark, "packed")
    places = written(write_matrices(packed(table(spark, sf_dir, "documents")), folder), "places")
    back = read_pieces(places)
    name = F.substring_index("shard", "/", -1)
    return back.select("doc_id", "piece", "start", name.alias("shard"), "row", "offset", "n_tokens", "ids_md5", "sound")


QUERIES = {"op10_pack_tokens": op10_pack_tokens}

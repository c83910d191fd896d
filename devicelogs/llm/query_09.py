"""op9_bpe_round_trip; not expressible in SQL, tested against the tokenizer itself."""

from pyspark.sql import functions as F

from .bpe import round_trip
from .common import read_table


def op9_bpe_round_trip(spark, sf_dir):
    rows = round_trip(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op9_bpe_round_trip": op9_bpe_round_trip}
ORACLE_SQL: dict[str, str] = {}

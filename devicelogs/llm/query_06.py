"""op6_toxicity_grammar; not expressible in SQL, tested by held-out accuracy and a brute-force grammar."""

from pyspark.sql import functions as F

from .common import held_out, read_table
from .toxicity import FOLD, FOLDS, THRESHOLD, score, train


def op6_toxicity_grammar(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", predicted)


QUERIES = {"op6_toxicity_grammar": op6_toxicity_grammar}
ORACLE_SQL: dict[str, str] = {}

"""op13_periodic_runs; not expressible in SQL, tested against brute force."""

from pyspark.sql import functions as F

from .common import read_table
from .periodic_runs import periodic_runs


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(read_table(spark, sf_dir, "documents"), stretch=True)
    return found.withColumn("collapsed_sha256", F.sha2(F.col("collapsed").cast("binary"), 256)).drop("collapsed")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE_SQL: dict[str, str] = {}

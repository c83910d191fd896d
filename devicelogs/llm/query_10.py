"""op10_best_fit_packing; not expressible in SQL, tested against brute force."""

from .common import read_table
from .packing import pack


def op10_best_fit_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}

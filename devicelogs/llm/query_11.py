"""op11_merkle_manifest; SQL can't hash level by level, tested against brute force."""

from .common import read_table
from .merkle import manifest


def op11_merkle_manifest(spark, sf_dir):
    return manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE_SQL: dict[str, str] = {}

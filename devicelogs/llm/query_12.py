"""op12_language_id; not expressible in SQL, tested against brute-force code lengths and by held-out accuracy."""

from .common import read_table
from .language_id import identify, train


def op12_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op12_language_id": op12_language_id}
ORACLE_SQL: dict[str, str] = {}

"""op3_jaccard_join; not expressible in SQL at this size, tested against brute force."""

from .common import read_table
from .jaccard_join import jaccard_components


def op3_jaccard_join(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE_SQL: dict[str, str] = {}

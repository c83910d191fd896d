"""op2_media_columns; not expressible in SQL, tested against brute force."""

from .common import read_table
from .media_columns import media_columns

COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]


def op2_media_columns(spark, sf_dir):
    return media_columns(read_table(spark, sf_dir, "documents")).select(*COLUMNS)


QUERIES = {"op2_media_columns": op2_media_columns}
ORACLE_SQL: dict[str, str] = {}

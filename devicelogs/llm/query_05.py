"""op5_html_extract."""

from .common import read_table
from .html_extract import extract_pages


def op5_html_extract(spark, sf_dir):
    return extract_pages(read_table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5_html_extract}
ORACLE_SQL: dict[str, str] = {}

"""op7_license_scan; the votes are not expressible in SQL, the base columns and labels are tested against brute force."""

from .common import read_table
from .license_scan import scan


def op7_license_scan(spark, sf_dir):
    return scan(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE_SQL: dict[str, str] = {}

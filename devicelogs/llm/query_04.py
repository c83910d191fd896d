"""op4_line_dedup."""

from .common import read_table
from .line_dedup import count_lines


def op4_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, ls FROM d WHERE text IS NOT NULL),
t AS (SELECT doc_id, pos, ls[pos + 1] AS line, trim(ls[pos + 1], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS cut FROM l),
w AS (SELECT doc_id, pos, cut AS a, lead(cut, 1) OVER o AS b, lead(cut, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w WHERE c IS NOT NULL AND a || b || c <> ''),
g AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM k WHERE n > 1),
s AS (SELECT t.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE g.pos IS NULL) AS rest
  FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.pos = g.pos GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS text
FROM d LEFT JOIN s USING (doc_id)"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {"op4_line_dedup": SQL}

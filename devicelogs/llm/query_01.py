"""op1_host_quality_rules."""

from .common import read_table
from .quality_rules import BASE_FAILED, HOST_LIMIT, HOST_RULES, quality_rules


def op1_host_quality_rules(spark, sf_dir):
    found = quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def _sql() -> str:
    counts = ", ".join(f"sum(({rule})::int) AS k_{n}" for n, rule in HOST_RULES.items())
    stats = ", ".join(f"greatest(least(sum(k_{n}) / sum(n), 0.999), 0.001) AS m_{n}, sum(k_{n}::DOUBLE * k_{n} / n) - sum(k_{n})::DOUBLE * sum(k_{n}) / sum(n) AS s_{n}" for n in HOST_RULES)
    alike = {n: f"(s_{n} / (m_{n} * (1 - m_{n})) - (hosts - 1)) / free" for n in HOST_RULES}
    weight = {n: f"(CASE WHEN free > 0 AND {alike[n]} > 0 THEN least(greatest(1 / ({alike[n]}) - 1, 1.0), 1000.0) ELSE 1000.0 END)" for n in HOST_RULES}
    flags = ", ".join(f"(k_{n} + m_{n} * {weight[n]}) / (n + {weight[n]}) > {HOST_LIMIT} AS e_{n}" for n in HOST_RULES)
    hit = " OR ".join(f"(e_{n} AND ({rule}))" for n, rule in HOST_RULES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
g AS (SELECT rid, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i + 7], ' ') END AS gram FROM p),
c AS (SELECT rid, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS twice FROM g),
r AS (SELECT rid, i, max(twice::int) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM c),
rep AS (SELECT rid, sum(inside) AS n_repeat_words FROM r GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dl USING (rid)),
h AS (SELECT source, count(*) AS n, {counts} FROM m WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS hosts, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS free, {stats} FROM h),
v AS (SELECT source, {flags} FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND NOT coalesce({hit}, false) AS kept
FROM m LEFT JOIN v USING (source)"""


QUERIES = {"op1_host_quality_rules": op1_host_quality_rules}
ORACLE_SQL = {"op1_host_quality_rules": _sql()}

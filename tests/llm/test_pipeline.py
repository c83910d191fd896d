import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from devicelogs.llm import quality_rules as rules  # noqa: E402
from test_jaccard_join import brute as near_brute  # noqa: E402
from test_line_dedup import brute as line_brute  # noqa: E402
from test_packing import check  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs.collect(), (made := stage(spark, docs, SF)).collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == columns
        docs = spark.createDataFrame(seen[name][1], made.schema) if name != corpus_pipeline.STAGES[-1][0] else made
    before, after = seen["quality_rules"]
    bad = set()
    for r in before:
        n, _, _, _, _, repeats = rules.measure(r.text)
        bad |= {r.doc_id} if n < 20 or 100 * repeats > 30 * n else set()
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} - bad and len(after) > 0.7 * len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality_classifier"]
    kept = {r.doc_id for r in after}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    assert sum(d in kept for d in good) > 0.97 * len(good)
    before, after = seen["line_dedup"]
    assert {r.doc_id: r.text for r in after} == line_brute([(r.doc_id, r.text) for r in before])
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_duplicates"]
    want = {d for d, (_, c) in near_brute([(r.doc_id, r.text) for r in before]).items() if c == d}
    assert {r.doc_id for r in after} == want and len(after) == len(want)
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    check([(r.length, r.sequence_id, r.offset) for r in after], 4096)


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() == 0, name
    long_text = " ".join(f"word{i}" for i in range(60))
    odd = spark.createDataFrame([(1, None, None, None, None, 1), (None, long_text, "en", None, 3, 2), (2, "", "en", "s", 0, 3), (3, long_text, "en", "s", 1, 4), (3, long_text, "en", "s", 1, 4)], "doc_id long, text string, lang string, source string, n_chars long, length int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, SF)
        assert made.columns == odd.columns, name
        made.collect()
    assert corpus_pipeline.best_fit_packing(spark, odd, SF).count() == 5


def test_near_duplicates_keep_unlike_texts_of_one_id(spark):
    x, y = (" ".join(f"{c}{k}" for k in range(30)) for c in "xy")
    rows = [(3, x), (7, x), (7, y)]
    names = ["_hash", "_doc", "_new", "_n_lines", "_score", "score", "text_hash"]
    docs = spark.createDataFrame([(d, t, *["v"] * len(names)) for d, t in rows], ["doc_id", "text", *names])
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, x), (7, y)]
    long_text = "\n".join(f"the {k} line of a long and plain text that goes on" for k in range(20_000))
    more = docs.withColumn("text", F.lit(long_text)).limit(1)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        made = stage(spark, more, SF)
        assert made.columns == docs.columns, name
        assert all(r.text == long_text for r in made.collect()), name

import pytest

from devicelogs.llm.line_dedup import count_lines, dedup_lines


def brute(docs):
    seen, gone = {}, {}
    for doc_id, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        lines = [x.strip(" \t\r\x0b\x0c") for x in text.split("\n")]
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(w) and seen.setdefault(w, (doc_id, k)) != (doc_id, k):
                gone.setdefault(doc_id, set()).update(range(k, k + 3))
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in docs}


def test_against_brute_force(spark):
    body = "\n".join(f"line {i}" for i in range(30))
    texts = [None, "", "a\nb", "a\nb\nc\nd", "x\na\n b \nc\r\ny", "z\nz\nz\nz\nz", "\n\n\n\n", "\n\nq\n\n", body, body, "head\n" + body + "\ntail", "w" * 100_000 + "\na\nb\nc"]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, pos string")
    assert dedup_lines(df).columns == df.columns
    got = count_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    rows = {r.doc_id: r for r in got.collect()}
    want = brute(docs)
    assert {i: r.text for i, r in rows.items()} == want
    assert rows[9].text == "" and rows[9].n_removed == 30 and rows[0].n_lines == 0 and rows[5].text == "z"
    assert rows[10].text == "head\ntail" and rows[6].text == "\n\n\n\n"


def test_repeated_null_and_no_rows(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(1, text), (1, text), (None, "e\nf\ng"), (None, "a\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in dedup_lines(df).collect()) == [(0, "a\nb\nc"), (0, "e\nf\ng"), (1, "d"), (1, "d")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = ["_hash", "_doc", "_new", "_n_lines", "row", "hash", "doc", "at", "new", "a.b", "h1"]
    rows = [(k, "a\nb\nc\nd" if k else "x", *[f"{n}{k}" for n in names]) for k in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(tuple(r)[2:] for r in got.collect()) == sorted(r[2:] for r in rows)
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["x", "a\nb\nc\nd", ""]
    with pytest.raises(ValueError):
        count_lines(df, n_lines="HASH")

import random
import re

from devicelogs.llm import license_scan as m
from devicelogs.llm.query_07 import op7_license_scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def base(text):
    ws, at, labels = words(text), [], set()
    for phrase, label in m.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), labels


MIT = m.TEMPLATES[0][1]


def test_base_and_labels(spark):
    broken = MIT.replace("free of charge", "free of any charge").replace("publish, ", "")
    texts = [None, "", "x", "CC-BY-NC 4.0; cc by nc cc by nc", "Released under the MIT License.", "Éé under the mit license under The MIT license!", MIT, "intro " * 50 + broken + " outro", "permission is hereby granted", "All rights reserved.", "w" * 200_000 + " cc by nc", "apache license, version 2.0", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(4, texts[4], "z"), (None, texts[4], None)], "doc_id long, text string, template string")
    rows = m.scan(df).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        n_words, n, first, last, labels = base(texts[4 if r.doc_id is None else r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n, first, last, ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    got = {r.doc_id: r for r in rows}
    assert got[6].labels == "mit" and got[6].score == 1 and got[7].labels == "mit" and 0.6 < got[7].score < 1
    assert got[8].labels == "" and got[9].labels == "proprietary" and got[12].labels == "gpl-3"
    assert m.scan(df.limit(0)).count() == 0


def test_siblings_and_repeats(spark):
    by = {(label, "lesser" in text): text for label, text in m.TEMPLATES}
    nc, sa, cc, gpl2, apache = by["cc-by-nc", False], by["cc-by-sa", False], by["cc-by", False], by["gpl-2", False], by["apache-2", False]
    gpl3 = next(t for label, t in m.TEMPLATES if label == "gpl-3" and "either" in t)
    lgpl = next(t for label, t in m.TEMPLATES if label == "lgpl")
    want = [(text, label) for label, text in m.TEMPLATES] + [
        ("Lorem ipsum " + cc + ". " + nc, "cc-by,cc-by-nc"),
        (nc.replace("NonCommercial", "NonCommercial-ShareAlike"), "cc-by-nc,cc-by-sa"),
        (lgpl + "; either version 3 of the License, or any later version", "lgpl"),
        (lgpl.replace("published", "made known") + "; either version 3 of the License, or any later version", "lgpl"),
        (gpl2.replace("version 2", "version 1"), ""),
        (gpl2.split(";")[0], ""),
        (gpl3.replace("terms", "written terms"), "gpl-3"),
        (apache.replace("not use", "not ever use").replace("except in", "except where in"), "apache-2"),
        ("All rights reserved. All rights reserved. x All rights reserved", "proprietary"),
        (sa.upper() + " " + gpl2, "cc-by-sa,gpl-2"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in m.scan(df).collect()}
    assert got == {i: labels for i, (_, labels) in enumerate(want)}


def slow_scan(text):
    """labels and score by the description, without hashes: votes, bands, islands, words, rivals."""
    ws = words(text)
    spans = []
    for number, (label, template, phrase) in enumerate(m.ALL_TEMPLATES):
        tw = [w.decode() for w in template]
        n = len(tw) - 2
        held = {}
        for p in range(len(ws) - 2):
            for q in range(n):
                if ws[p : p + 3] == tw[q : q + 3]:
                    held.setdefault(p - q, set()).add(q)
        whole = [(d, d + len(tw)) for d, qs in held.items() if len(qs) == n]
        tries = [] if phrase else whole
        spans += [(label, True, a, b, 1.0, len(tw)) for a, b in whole] if phrase else []
        bands, last = [], None
        for d in sorted(d for d, qs in held.items() if len(qs) < n and not phrase):
            if last is None or d - last > 2 * m.NEAR:
                bands.append([])
            bands[-1].append((d + min(held[d]), d, d + max(held[d]) + 3, held[d]))
            last = d
        for band in bands:
            island = None
            for start, _, end, qs in sorted(band, key=lambda x: x[:2]) + [(10**9, 0, 0, set())]:
                if island and start > island[1] + m.NEAR:
                    if len(island[2]) >= 0.3 * n and island[1] - island[0] <= 1.5 * len(tw):
                        tries = [*tries, island[:2]]
                    island = None
                island = (min(island[0], start), max(island[1], end), island[2] | qs) if island else (start, end, qs)
        for a, b in tries:
            span = ws[a:b]
            table = {}
            for i in range(len(tw) + 1):
                for j in range(len(span) + 1):
                    table[i, j] = 0 if not i or not j else table[i - 1, j - 1] + 1 if tw[i - 1] == span[j - 1] else max(table[i - 1, j], table[i, j - 1])
            share = table[len(tw), len(span)] / len(tw)
            if share >= 0.75 and m.TELLING.get(label, span[0]) in span:
                spans.append((label, False, a, b, share, len(tw)))
    rank = lambda s: (s[0] == "lgpl", s[4], s[5])
    rivals, won = [s for s in spans if not s[1]], []
    for x in sorted(rivals, key=rank, reverse=True):
        covers = [w for w in won if 2 * (min(x[3], w[3]) - max(x[2], w[2])) > min(x[3] - x[2], w[3] - w[2])]
        if all(rank(w) == rank(x) for w in covers):
            won.append(x)
    all_ = won + [s for s in spans if s[1]]
    return ",".join(sorted({s[0] for s in all_})), max((s[4] for s in all_), default=0.0)


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    for label, template in m.TEMPLATES * 3:
        ws = template.split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            k = rng.randrange(len(ws))
            ws[k : k + rng.choice([0, 1])] = rng.choice([[], ["x"], ["version"], [ws[k], ws[k]]])
        texts.append("word " * rng.randint(0, 9) + " ".join(ws) + rng.choice(["", " under the MIT license", " " + rng.choice(m.TEMPLATES)[1]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in m.scan(df).collect():
        labels, score = slow_scan(texts[r.doc_id])
        assert (r.labels, round(r.score, 9)) == (labels, round(score, 9)), texts[r.doc_id][-300:]


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op7_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_words, n, first, last, labels = base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n, first, last, ",".join(sorted(labels)))

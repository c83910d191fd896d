import math
import random
import re
import time

import numpy as np

from devicelogs.llm.html_extract import LINK_SHARE, MENU_LINES, Lines, content_lines, extract, extract_pages, smoothed

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header>site</header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy</div><div class="cookie-notice">cookies</div>
<article><h1>Head &amp; &eacute;</h1><p><b>One
 two.<br><p>Three&nbsp;four.</p>{more}<form><input value=1>form</form><aside>side</aside><p>Last <em>in</em>line.</p></article>
<section class="comments"><h2>Comments</h2><p>reader says a long long sentence that is no content at all</p></section><footer>&copy; x</footer>"""


def test_article_without_the_rest():
    assert extract(PAGE.replace("{more}", "<p>Sh is.</p>")) == "Head & é One two. Three four. Sh is. Last inline."
    inner = '<div id="comments"><p>reader</p></div><p hidden>gone</p>'
    assert extract(PAGE.replace("{more}", inner)) == "Head & é One two. Three four. Last inline."


def test_wrappers_keep_their_article():
    article = '<article><p>one text of words.</p><div class="ad">buy</div></article>'
    for name in ("content has-sidebar", "with-sidebar", "no-header", "page-widget-container", "sidebar"):
        assert extract(f'<div class="{name}">{article}<p class="related">more</p></div><p>foot</p>') == "one text of words."
    assert extract('<div class="page-widget-container"><p>one text of words.</p></div>') == "one text of words."
    assert extract(f'{article}<div class="widget"><article>card card card</article></div>') == "one text of words."
    assert extract('<p>one text of words.</p><div id="comments"><article>reader</article></div>') == "one text of words."


def test_no_article_uses_ratios():
    menu = "".join(f'<li><a href="/{i}">m{i}</a></li>' for i in range(20))
    text = "<p>" + "word " * 60 + "end.</p><p>short</p><p>" + "more " * 60 + "end.</p>"
    got = extract(f"<body><ul>{menu}</ul><div>{text}</div><ul>{menu}</ul></body>")
    assert "word" in got and "short" in got and got.endswith("end.") and "m3" not in got


def test_edges():
    assert extract(None) == extract("") == extract("<p>") == extract("<!-- x -->") == ""
    assert extract("plain text") == "plain text"
    assert extract("<article>" + "x " * 100_000 + "</article>") == " ".join(["x"] * 100_000)
    assert np.allclose(smoothed(np.ones(9)), 1)


def test_generated_pages_match_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:b|a|i|em)>", "", inner).replace("<", " <") and re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_null_and_clashing_columns(spark):
    rows = [(None, None, None, "x"), (1, "u", "<article><p>a</p></article>", "y"), (1, "u", "<article><p>a</p></article>", "y")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, "a"), (1, "a")]


def test_no_markup_stops_a_page():
    assert extract("<article><p>a<![foo[bar]]>b</p></article>") == "ab"
    assert extract("<article><p>a<!-- b <p>c</p></article><p>d</p>") == "ac"
    assert extract("<article><p>a < b <c</p>") == "a < b"
    assert extract("<article><p>one</p><p>a <b") == "one a <b"


def test_elements_end_where_html_ends_them():
    assert extract('<article><p>long text of words</p><ul><li class="ad">Buy<li>item one<li>item two</ul></article>') == "long text of words item one item two"
    assert extract('<article><table><tr><td class="ad">Buy<td>cell<tr><td>next</table><dl><dt class="ad">no<dd>yes</dl></article>') == "cell next yes"
    assert extract('<article><p class="ad">no <b>bold<div>yes</div></article>') == "yes"
    assert extract("<article><ul><li>a<ul><li>b</ul>c<li>d</ul></article>") == "a b c d"


def test_words_of_the_article_stay():
    assert extract("<article><p>Let <math><mi>x</mi></math> be <label>real</label>.</p></article>") == "Let x be real."
    assert extract('<article><div class="related-work"><p>others did</p></div><p class="share price">it rose</p></article>') == "others did it rose"
    assert extract('<article><p>text</p><div class="related-posts">more</div><div class="share buttons">tweet</div></article>') == "text"


def test_titles_and_short_ends_stay_without_an_article():
    body = "<h1>Title</h1><p>" + "word " * 60 + "end.</p><p>short</p>"
    menu = "".join(f'<li><a href="/{i}">m{i}</a></li>' for i in range(20))
    got = extract(f"<body><ul>{menu}</ul><div>{body}</div><div>(c) site</div></body>")
    assert got == "Title " + "word " * 60 + "end. short"


def test_references_of_an_article_stay_and_its_menus_go():
    links = "".join(f'<li><a href="/{i}">page {i}</a></li>' for i in range(6))
    text, plain = "<p>" + "word " * 80 + "end.</p><p>short</p>", "word " * 80 + "end. short"
    shown = " ".join(f"page {i}" for i in range(6))
    assert extract(f"<article>{text}<ul>{links}</ul></article>") == f"{plain} {shown}"
    assert extract(f"<article>{text}<nav>{links}</nav><ul class='menu'>{links}</ul></article>") == plain
    ends = "".join(f'<p><a href="/{i}">page {i}</a></p>' for i in range(6))
    assert extract(f"<article>{text}{ends}</article>") == f"{plain} {shown}"
    lines = "<p>" + "word " * 80 + "end.</p>"
    got = extract(f"<div>{lines * 4}</div><ul>{links}</ul><div>{lines * 4}</div>")
    assert got.count("end.") == 8 and "page" not in got  # between blocks of no article they are a menu


def test_inline_ends_end_no_blocks():
    assert extract("<b><article><p>one</b><p>two</p></article>") == "one two"
    assert extract("<a><article><p>one</p></a><p>two</p></article>") == "one two"
    assert extract("<article><p>a<b>b<p>c</b>d</p><p>e</p></article>") == "ab cd e"
    assert extract('<article><p>a</p><b class="ad">buy<div>buy</b>one</div><p>two</p></article>') == "a one two"
    assert extract('<b class="ad"><div class="menu">buy</b>menu</div><article><p>one</p></article>') == "one"
    assert extract('<span class="ad"><article><p>one</span><p>two</p></article><p>foot</p>') == "one two"
    assert Lines().read("<i><article><a>x</i><p>y</a>z</p></article>")[-1].linked == 1


def test_hostile_inline_ends_take_seconds():
    began = time.time()
    for page in ("<b><div>" * 40_000 + "</b>" * 40_000, "<b>" * 40_000 + "<i>" * 40_000 + "<div>" + "</b>" * 40_000, '<b class="ad"><div></b>' * 20_000):
        extract("<article>" + page + "</div>x")
    assert time.time() - began < 60


def test_hostile_pages_take_seconds():
    began = time.time()
    for part in ("<b>", "</i>", "<a ", "<!--", "<!-- >", "<p><b>", "<a x='", "</a ", "<![foo[bar]]>", "<", "<ul><li>", "<td>", "<li><b>"):
        extract("<article>" + part * (300_000 // len(part)))
    extract("<b>" * 20_000 + "</i>" * 20_000)
    assert time.time() - began < 60


def slow_content(lines):
    """The described choice, line by line and number by number."""
    if not lines:
        return []
    heeded = 0 if any(x.region and x.skipped == 0 for x in lines) else 1 if any(x.skipped < 2 for x in lines) else 2
    given = [0 if x.skipped > heeded else max(len(x.text) - x.linked, 0) / max(x.tags, 1) * (4 if x.region else 1) for x in lines]
    smooth = []
    for k in range(len(given)):
        near = [(given[i], math.exp(-((i - k) ** 2) / 2)) for i in range(max(0, k - 3), min(len(given), k + 4))]
        smooth.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    mean = sum(given) / len(given)
    limit = min(math.sqrt(sum((v - mean) ** 2 for v in given) / len(given)), max(smooth))
    high = [s >= limit - 1e-9 and v > 0 for s, v in zip(smooth, given)]
    votes = {}
    for x, s, h in zip(lines, smooth, high):
        if h:
            votes[x.region] = votes.get(x.region, 0) + s
    chosen = {r for r, v in votes.items() if v >= 0.1 * max(votes.values())}
    if chosen - {0}:
        return [x.region in chosen - {0} and x.skipped <= heeded for x in lines]
    menu = set()
    for k in range(len(lines) - MENU_LINES + 1):
        run = range(k, k + MENU_LINES)
        if all(not lines[i].region and smooth[i] < limit - 1e-9 and lines[i].linked >= LINK_SHARE * len("".join(lines[i].text.split())) for i in run):
            menu |= set(run)
    fits = [x.skipped <= heeded and k not in menu for k, x in enumerate(lines)]
    if not any(high):
        return [f and (not any(x.region for x in lines) or x.region > 0) for f, x in zip(fits, lines)]
    ends = [k for k, h in enumerate(high) if h]
    first, last = ends[0], ends[-1]
    while first and fits[first - 1] and lines[first - 1].box == lines[ends[0]].box and not lines[first - 1].region:
        first -= 1
    while last + 1 < len(lines) and fits[last + 1] and lines[last + 1].box == lines[ends[-1]].box and not lines[last + 1].region:
        last += 1
    return [f and first <= k <= last for k, f in enumerate(fits)]


def test_ratios_against_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    links = "".join(f'<li><a href="/{i}">other page {i}</a></li>' for i in range(9))
    pages += [f"<p>teaser text</p><article><p>{'w ' * n}</p><ul>{links}</ul><p>{'v ' * 50}</p></article><article><p>x</p></article>" for n in (1, 9, 80, 400)]
    pages += [re.sub(r"<(/?)article", r"<\1div", html) for html in pages]
    rng = random.Random(3)
    parts = ["<ul>" + links + "</ul>", "<div>", "</div>", "<p>few</p>", f"<p>{'many ' * 60}</p>", f"<p>{'some ' * 15}<a>link</a></p>", "<nav>menu</nav>", "<h2>head</h2>", '<p class="ad">buy</p>']
    pages += ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(400)]
    dropped = 0
    for html in pages:
        lines = Lines().read(html)
        want = slow_content(lines)
        assert content_lines(lines) == want
        dropped += any(not w and x.skipped == 0 for x, w in zip(lines, want))
    assert dropped


def test_ids_keep_their_type(spark):
    rows = [("a", "u", "<article><p>a</p></article>"), (None, "u", "<p>b</p>")]
    assert {(r.page_id, r.text) for r in extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()} == {("a", "a"), (None, "b")}
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

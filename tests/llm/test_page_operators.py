"""Main text of pages, WARC archives and vector search on small fixtures."""

from __future__ import annotations

import hashlib

from fractions import Fraction
from math import floor
from operator import mul

import numpy as np
import pandas as pd
import pytest
from conftest import agree
from pyspark.sql import functions as F

from chargeaudit.llm import html_text, topk_search, warc

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
SHELL = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a></ul></nav>{}<aside>side</aside><div class='cookie-notice'>cookies</div><form><p>Mail <input></form><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><h1>T &amp; t</h1><p>One <b>bo</b>ld.<p>Two<br>lines</article>", "T & t\nOne bold.\nTwo lines"),
        ("<article><h1>T</h1><script>var a='<p>';</script><p>A<div class='ad'>Buy</div><p>B</p><section id='comments'><p>nice</p></section></article>", "T\nA\nB"),
        ("<main><p>A&nbsp;&nbsp; b\n c</p><!-- <p>no</p> --><ul><li>x<li>y</ul></main>", "A b c\nx\ny"),
        ("<div id='content'><p>Long text of the page, which has no article.</p><p>More of it.</p></div>", "Long text of the page, which has no article.\nMore of it."),
        ("<article><p>Cut off he", "Cut off he"),
        ("<article></article>", ""),
    ],
)
def test_one_page(body, text):
    page = SHELL.format(body) if "Cut off" not in body else SHELL.format(body).split("<aside>")[0]
    assert html_text.main_text(page, html_text.Place(0, ""), {}) == text


@pytest.mark.parametrize(
    "page",
    [
        "<body class='no-sidebar'>{}</body>",
        "<body><main class='has-comments'>{}</main></body>",
        "<body><div id='page' class='right-sidebar'>{}</div></body>",
        "<body><form action=/><div class='with-header'>{}</div></form></body>",
        "<body class='menu'><div class=sidebar-left><form>{}</form></div></body>",
    ],
)
@pytest.mark.parametrize("tag", ["article", "article class=post-share", "div"])
def test_wrappers_are_no_noise(page, tag):
    body = f"<nav><a>Home</a></nav><{tag}><p>Some <b>bold</b> text of the page.</p><p>More of it, and more than all comments.</p></{tag.split()[0]}>"
    html = "<html><head><title>t</title></head>" + page.format(body + "<div class=ad>Buy</div><section id=comments><article class=comment-7><p>nice</p></article></section>") + "</html>"
    assert html_text.main_text(html, html_text.Place(0, ""), {}) == "Some bold text of the page.\nMore of it, and more than all comments."


def test_comments_stay_noise():
    page = "<body><main><p>Short.</p><section id=comments><article><p>A comment that is longer than the page.</p></article></section></main><form>Mail us at once</form></body>"
    assert html_text.main_text(page, html_text.Place(0, ""), {}) == "Short."


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h.example/{i}", SHELL.format(f"<article><h1>Title {i}</h1><p>Body {i} {'w ' * i}</p><p>Follow us</p></article>"), "clash", "clash") for i in range(20)]
    rows += [(100 + i, f"https://u@Other.example:80?{i}", SHELL.format(f"<div class=story><p>Story {i} with words that differ {i * 7}</p></div><div class=links><p><a>more {i}</a></p></div>"), "", "") for i in range(6)]
    rows += [(200, None, None, "", ""), (201, "x", "", "", ""), (202, "y", "plain", "", ""), rows[0], (None, "http://h.example/z", "<p>z", "", "")]
    rows += [(300, "big", SHELL.format("<article>" + "<p>" + "é" * 70_000 + "</p>" * 3 + "</article>"), "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_templates(pages):
    got = html_text.extract(pages).toPandas()
    assert len(got) == pages.count()
    by = {r.page_id: r for r in got.itertuples()}
    assert by[3].text == "Title 3\nBody 3 w w w\nFollow us"  # what recurs inside the article is of the article
    assert by[102].text == "Story 2 with words that differ 14"
    assert by[200].text == by[201].text == "" and by[202].text == "plain" and by[300].n_chars == 70_000
    assert html_text.extract(pages.limit(0)).count() == 0


def test_near_copies_are_no_template(spark):
    """A host of copies and near copies of one article, and a few others that quote it."""
    body = [f"Paragraph {k} of the article, long enough to be most of it." for k in range(6)]
    article = lambda ps: SHELL.format("<article>" + "".join(f"<p>{p}</p>" for p in [*ps, "Follow us"]) + "</article><div class=more><p>Outside of it</p></div>")
    texts = [body] * 10 + [[*body[: i % 6], f"Altered {i}", *body[i % 6 + 1 :]] for i in range(20)] + [[f"Other page {i} with words of its own, and with a quotation:", body[1]] for i in range(3)]
    rows = [(i, f"http://copies.example/{i}", article(t), "", "") for i, t in enumerate(texts)]
    rows += [(100 + i, f"http://mixed.example/{i}", article(body if i < 40 else [f"Page {i} has {i * 7} words of its own"]), "", "") for i in range(60)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == "\n".join([*t, "Follow us"])
    assert got[100] == "\n".join([*body, "Follow us"]) and got[150] == "Page 50 has 350 words of its own\nFollow us"


def neutral(i: int) -> tuple[str, str]:
    """A page whose names say nothing, and its text."""
    rng = np.random.default_rng(i)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    body = [f"Title {word(4)}", *[f"Paragraph {word(30)}." for _ in range(2 + i % 4)], "By the same author as ever."]
    text = "".join(f"<h1>{b}</h1>" if k == 0 else f"<p>{b}</p>" for k, b in enumerate(body))
    records = "".join(f"<div class=foxtrot><b class=golf>user{rng.integers(99)}</b><div class=hotel>{word(6)}</div></div>" for _ in range(1 + i % 3))
    menu = "".join(f"<div class=india><a href=/{x}>{x}</a></div>" for x in word(5).split())
    page = f"<html><body><div class=alpha>{menu}</div><div class=bravo>{word(7)}</div><div class=charlie>{text}<div class=kilo>Sent to you by the house with care</div><div class=echo>{records}</div></div><div class=delta>All rights are with us since {word(3)}</div></body></html>"
    return page, "\n".join(body)


def test_template_decides(spark):
    """Names say nothing and there is no article: only the pages of the host together tell what is text."""
    made = [neutral(i) for i in range(30)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(i, f"http://n.example/{i}", p, "", "") for i, (p, _) in enumerate(made)], SCHEMA)).collect()}
    for i, (page, text) in enumerate(made):
        assert got[i] == text
        assert html_text.main_text(page, html_text.Place(0, ""), {}) != text


def whole(spark, pages: list[str]) -> list[str]:
    rows = html_text.extract(spark.createDataFrame([(i, f"http://n.example/{i}", p, "", "") for i, p in enumerate(pages)], SCHEMA)).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.page_id)]


def sentence(rng, n: int) -> str:
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_steps_stay(spark):
    """Parts of one class that repeat on every page are the article's."""
    rng = np.random.default_rng(1)
    pages, texts = [], []
    for i in range(12):
        paragraphs, steps = [sentence(rng, 20) for _ in range(6)], [(f"Step {k}", sentence(rng, 12)) for k in range(4 + (i % 3 if i > 5 else 0))]
        pages.append("<html><body><nav><a>Home</a></nav><main>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "".join(f"<div class=step><h3 class=steptitle>{a}</h3><div class=stepbody>{b}</div></div>" for a, b in steps) + "</main></body></html>")
        texts.append("\n".join([*paragraphs, *(x for s in steps for x in s)]))
    assert whole(spark, pages) == texts


def test_recurring_parts_of_an_article_stay(spark):
    rng = np.random.default_rng(2)
    bodies = [[sentence(rng, 25) for _ in range(3)] for _ in range(12)]
    pages = ["<html><body><header>Site</header><article><h1>T</h1><div class=summary>This sentence stands above every one of our reports.</div>" + "".join(f"<p>{p}</p>" for p in b) + "<div class=share-bar>Share it</div></article><footer>f</footer></body></html>" for b in bodies]
    assert whole(spark, pages) == ["\n".join(["T", "This sentence stands above every one of our reports.", *b]) for b in bodies]


@pytest.mark.parametrize("names", [("col1", "col2", "col3"), ("col-11", "col-12", "col-13"), ("xa", "xb", "xc")])
def test_numbered_columns(spark, names):
    """Columns that differ by a number are different places; entries whose numbers differ from page to page are one."""
    rng = np.random.default_rng(3)
    bodies = [[sentence(rng, 25) for _ in range(2 + i % 3)] for i in range(12)]
    pages = []
    for i, b in enumerate(bodies):
        menu = "".join(f"<span><a href=/{x}>topic {x}</a></span> " for x in range(6))
        entry = f"<div id=post-{i} class=entry>" + "".join(f"<p>{p}</p>" for p in b) + "</div>"
        pages.append(f"<html><body><div class={names[0]}>{menu}</div><div class={names[1]}>{entry}</div><div class={names[2]}>Made by the house in the year of the house</div></body></html>")
    assert whole(spark, pages) == ["\n".join(b) for b in bodies]


def test_comments_go(spark):
    """By their names, and without names by their varying number and the short line that each begins with."""
    rng = np.random.default_rng(4)
    for comment in ("<section id=comments>{}</section>", "<div class=zz>{}</div>"):
        bodies = [[sentence(rng, 30) for _ in range(4)] for _ in range(15)]
        pages = ["<html><body><main>" + "".join(f"<p>{p}</p>" for p in b) + comment.format("".join(f"<div class=qq><i class=rr>user{rng.integers(99)}</i><div class=ss>{sentence(rng, 8)}</div></div>" for _ in range(1 + i % 4))) + "</main></body></html>" for i, b in enumerate(bodies)]
        assert whole(spark, pages) == ["\n".join(b) for b in bodies]


def test_classes_are_those_of_whole_vectors(spark):
    """Equivalence classes by sums of random numbers are those by the occurrences on each page."""
    made = [neutral(i)[0] for i in range(12)] + [SHELL.format(f"<article><p>{'same words ' * (i % 3)}</p></article>") for i in range(6)]
    exact: dict[int, dict[int, int]] = {}
    for i, page in enumerate(made):
        own, words = html_text.page_tokens(page, html_text.Place(0, ""))
        for token, n in [*((k, x[2]) for k, x in own.items()), *((html_text.word_token(*k), n) for k, n in words.items())]:
            exact.setdefault(token, {})[i] = n
    want: dict[tuple, set] = {}
    for token, on in exact.items():
        if 2 * len(on) >= len(made):
            want.setdefault(tuple(sorted(on.items())), set()).add(token)
    df = spark.createDataFrame([(i, "http://n/", p) for i, p in enumerate(made)], "page_id long, url string, html string").repartition(5)
    totals = df.select(html_text.host_column(F.col("url")).alias("_host")).distinct()
    got: dict[int, set] = {}
    for r in html_text.tokens(df, totals).filter(f"2 * pages >= {len(made)}").collect():
        got.setdefault(r.vector, set()).add(r.token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 5


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "<p>Deep text</p>" + "</div>" * 5000
    rows = [(i, "http://d/", x, "", "") for i, x in enumerate([deep, deep.replace("div", "b"), "<nav>" * 3000 + "x", "<p>a" * 3000] * 2)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == got[1] == got[4] == "Deep text" and got[2] == "" and got[3] == "\n".join("a" * 3000)


def test_hosts(spark):
    urls = ["http://A.b/c?d", "https://a.B#q", "https://u@a.b?x", "//k", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(html_text.host_column(F.col("u"))).collect()]
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] != got[0] and min(got) >= 0


def test_warc_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, segment=5000)
    back = warc.read_warc(spark, path).toPandas()
    assert back.problem.isna().all() and len(back) == pages.count()
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for r in back.itertuples():
        page = None if pd.isna(r.page_id) else int(r.page_id)
        assert r.payload_bytes == len(want[page]) and r.payload_digest == hashlib.sha1(want[page]).hexdigest()
        assert bytes(r.payload) == want[page] if r.record_type == "response" else r.payload is None
    assert (warc.read_segments(spark, path).filter("type = 'continuation'").count()) > 10


def test_warc_finds_lost_segments(spark, pages, tmp_path):
    path = tmp_path / "w"
    warc.write_warc(pages.filter("page_id = 300"), str(path), segment=5000)
    files = [f for f in path.iterdir() if f.name.startswith("part")]
    import gzip

    data = gzip.decompress(files[0].read_bytes())
    at = data.index(b"WARC-Segment-Number: 3")
    start = data.rindex(b"WARC/1.1", 0, at)
    files[0].with_name("part-x").write_bytes(data[:start] + data[data.index(b"WARC/1.1", at) :])
    files[0].unlink()
    assert [r.problem for r in warc.read_warc(spark, str(path)).collect()] == ["segments missing or repeated"]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_keeps_bytes_and_bounds_files(spark, tmp_path, monkeypatch):
    """Bytes that are no UTF-8 come back as they were; a file holds RECORDS records at most."""
    monkeypatch.setattr(warc, "RECORDS", 4)
    raw = F.unhex(F.concat(F.lit("FF00C3"), F.repeat(F.lit("41E2820D0A0D0A"), F.col("page_id").cast("int") * 400)))
    pages = spark.range(9).withColumnRenamed("id", "page_id").select("page_id", F.lit("http://h/").alias("url"), raw.cast("string").alias("html"))
    path = tmp_path / "w"
    warc.write_warc(pages.coalesce(1), str(path), segment=5000)
    back = {r.page_id: r for r in warc.read_warc(spark, str(path)).collect()}
    for i in range(9):
        want = b"\xff\x00\xc3" + bytes.fromhex("41E2820D0A0D0A") * 400 * i
        assert bytes(back[i].payload) == want and back[i].payload_digest == hashlib.sha1(want).hexdigest() and back[i].problem is None
    segments = warc.read_segments(spark, str(path)).count()
    assert segments > 20 and len(list(path.glob("part-*"))) == -(-segments // 4)


def test_warc_contract(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * (1000 if i % 2 else 999) + str(i % 3)[: i % 2], "", "") for i in range(30)] + [(31, "u", None, "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    agree(warc.op10_warc(spark, str(tmp_path)), warc.ORACLE, None, pages=frame)
    empty = tmp_path / "e"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "pages.parquet"))
    assert warc.op10_warc(spark, str(empty)).count() == 0


def vectors() -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = [(i, [*map(float, rng.integers(-3, 4, 8) / 4)], "c") for i in range(200)]
    rows += [(200, None, ""), (250, [1.0, None], ""), (300, [float("nan")] * 8, ""), (350, [float("inf")] * 8, ""), (400, [], ""), (450, [0.5] * 3, ""), (451, [0.25] * 3, ""), (500, [-1000.5] * 8, "")]
    rows += [(550 + i, [1e8 * (i % 3 - 1), -3e20, 1e300, float(i), 0.5, 1.0, -1e8, 2.0], "") for i in range(12)]
    rows += [(700 + i, [0.25, 1.0] * 4, "") for i in range(60)]
    return [*rows, rows[7], rows[50], rows[100], (None, [1.0] * 8, "")]


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 50)
    monkeypatch.setattr(topk_search, "QUERIES_PER_CHUNK", 2)
    monkeypatch.setattr(topk_search, "STRETCH", 3)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, rank string")
    got = topk_search.search(df, F.col("vec_id") % 50 == 0, k=5).toPandas()
    fine = [(r, i, [floor(256 * Fraction(x)) for x in v]) for r, (i, v, _) in enumerate(vectors()) if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for r, i, q in fine:
        if i % 50 == 0:
            # all rows but the query's own, also those of its vec_id; huge scores are ranked as they are and shown cut to 64 bits
            scored = sorted(((-sum(map(mul, q, v)), j) for o, j, v in fine if o != r and len(v) == len(q)))[:5]
            want += [(i, n, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scored, 1)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(want)
    assert topk_search.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-300, 300, (100, 6)) / 7, rng.integers(-300, 300, (7, 6)).astype(float)
    whole = np.floor(256 * x)
    grid = topk_search.Grid(whole.min(axis=0), whole.max(axis=0))
    low, high = grid.bounds(q, grid.cells(x))
    assert (low <= q @ whole.T).all() and (q @ whole.T <= high).all()
    assert (high - low < 0.02 * np.abs(q).sum(axis=1)[:, None] * (whole.max() - whole.min())).all()  # far narrower than the grid

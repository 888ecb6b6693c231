import time

from skygauge.llm import html_extract
from tests.llm.util import SF

LONG = "The harbour lay quiet in the morning and the boats came in one after another with their nets full of fish. "

PAGE = f"""<!doctype html><html><head><title>Title</title><style>p {{color: red}}</style>
<script>var x = "<p>not text</p>";</script></head><body>
<header><a href=/>Home</a> The site</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, please agree to all of them now.</div>
<main><article><h1>The  harbour</h1>
<p>{LONG * 3}</p><p>Fish &amp; chips&nbsp;cost &#163;5 &lt;today&gt;.</p>
<aside>Related things to read</aside><p>{LONG * 2}<a href=/x>More</a> at the end.</p>
<form><input value=q> Search here</form><!-- hidden <p>comment</p> --></article></main>
<section id="comments"><p>{LONG} says a reader.</p></section>
<div class="sidebar">Side</div><footer>Copyright</footer></body></html>"""


def test_article_alone_is_left():
    blocks = html_extract.main_text(PAGE).split("\n\n")
    assert blocks == [
        "The harbour",
        (LONG * 3).strip(),
        "Fish & chips cost £5 <today>.",
        f"{LONG * 2}More at the end.",
    ]


def test_plain_divs_without_roles():
    page = f"""<body><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div>
    <div><div><p>{LONG * 2}</p><p>{LONG * 3}</p></div></div><div><a href=4>d</a></div></body>"""
    assert html_extract.main_text(page) == f"{(LONG * 2).strip()}\n\n{(LONG * 3).strip()}"


def test_broken_and_deep_markup():
    assert html_extract.main_text(f"<p>{LONG}<p>{LONG}</div></p><b>") == f"{LONG.strip()}\n\n{LONG.strip()}"
    deep = "<div>" * 50_000 + LONG + "</div>" * 50_000
    assert html_extract.main_text(deep) == LONG.strip()
    for odd in (None, "", " ", "<", "<p", "<!-- ", "<script>", "</p>", "<body></body>"):
        html_extract.main_text(odd)
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<!-- x") == ""


def test_rows_and_columns(spark):
    schema = "page_id bigint, url string, html string, text string, extra string"
    rows = [(1, "u", PAGE, "old", "e"), (1, "u", PAGE, "old", "e"), (2, None, None, None, None), (None, "v", "", "", "")]
    df = spark.createDataFrame(rows, schema)
    out = html_extract.extract(df).collect()
    assert out[0].asDict().keys() == {"page_id", "url", "extra", "text", "n_chars"}
    assert len(out) == 4 and out[0] == out[1] and out[2]["text"] == "" and out[3]["n_chars"] == 0
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pages_lose_their_frame(spark):
    rows = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    texts = [r["text"] for r in rows]
    assert sum(bool(t) for t in texts) >= 0.9 * len(texts)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("<script" in t or "</" in t for t in texts)


def test_head_without_end_tag():
    body = f"<main><p>{LONG * 3}</p><p>{LONG * 2}</p></main>"
    want = f"{(LONG * 3).strip()}\n\n{(LONG * 2).strip()}"
    for page in (
        f"<html><head><title>T</title><meta charset=utf-8><body>{body}</body></html>",
        f"<html><head><title>T</title><style>p {{}}</style>{body}</html>",
        f"<html><head><title>T</title><noscript><link href=x><body>{body}</body></html>",
    ):
        assert html_extract.main_text(page) == want


def test_form_around_the_page_is_a_container():
    search = "<div><input value=q><button>Search</button><select><option>One</select></div>"
    for body in (f"<article><p>{LONG * 3}</p></article>", f"<div><p>{LONG * 2}</p><p>{LONG}</p></div>"):
        page = f"<html><body><form id=aspnetForm>{search}{body}</form><div>Short end</div></body></html>"
        assert LONG.strip() in html_extract.main_text(page) and "Search" not in html_extract.main_text(page)
    page = f"<body><div><p>{LONG * 3}</p></div><form><p>Send us your name and address</p></form></body>"
    assert html_extract.main_text(page) == (LONG * 3).strip()


def test_wrappers_named_after_what_they_have_keep_the_article():
    article, want = f"<article><p>{LONG * 3}</p></article>", (LONG * 3).strip()
    for name in ('id=page class="site has-sidebar"', 'class="no-banner wide"', 'class="content sidebar-right"'):
        page = f"<body><div {name}><nav>x</nav>{article}<div class=sidebar>Side</div></div></body>"
        assert html_extract.main_text(page) == want
    thread = f"<section id=comments>{'<article><p>' + LONG * 4 + '</p></article>'}</section>"
    assert html_extract.main_text(f"<body>{article}{thread}</body>") == want  # comments are longer, but no content


def test_stray_markup_takes_linear_time():
    n = 60_000
    for page in ("<b>" * n + "</i>" * n, "<a x " * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<h1>" * n, "<!x " * n):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 10


def test_clashing_and_dotted_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "x", "y")], ["page_id", "html", "a.b", "Text"])
    row = html_extract.extract(df).first()
    assert row["a.b"] == "x" and row["text"].startswith("The harbour") and set(row.asDict()) == {"page_id", "a.b", "text", "n_chars"}

"""Main text of pages: furniture goes, the whole article stays, broken markup and edge rows."""
import pytest

from montevar.llm import html_text
from tests.llm.helpers import prose, rng

P = [prose(rng(k), n) for k, n in enumerate((40, 60, 3, 80))]
ARTICLE = "<article><h1>The title</h1>" + "".join(f"<p>{p}</p>" for p in P) + "</article>"
WANT = "\n".join(["The title", *P])
FURNITURE = {
    "menu": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of the day and more</a></li></ul></nav>",
    "header": "<header><p>A site about many things</p></header>",
    "footer": "<footer>&copy; 2020 someone &middot; all of it</footer>",
    "sidebar": "<aside><p>" + prose(rng(9), 30) + "</p></aside>",
    "side_div": "<div id='left-sidebar'><p>" + prose(rng(10), 30) + "</p></div>",
    "advert": "<div class='ad'>Buy this now, it is very cheap.</div>",
    "notice": "<div class='cookie-notice'><p>We use cookies for this and that.</p></div>",
    "form": "<form><label>Mail</label><input name=q><button>Send</button></form>",
    "script": "<script>var t = '</p><p>no';</script><style>p{margin:0}</style>",
    "comments": "<section class='comments'>" + "".join(f"<div><p>{prose(rng(k), 50)}</p></div>" for k in range(20, 26)) + "</section>",
    "hidden": "<div style='display: none'><p>" + prose(rng(11), 40) + "</p></div>",
    "noscript": "<noscript><p>Please switch it on.</p></noscript>",
}


@pytest.mark.parametrize("name", FURNITURE)
@pytest.mark.parametrize("before", (True, False))
def test_furniture_goes(name, before):
    one, two = (FURNITURE[name], "") if before else ("", FURNITURE[name])
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{one}{ARTICLE}{two}</body></html>") == WANT
    inside = ARTICLE.replace("</article>", FURNITURE[name] + "</article>")
    assert html_text.main_text(f"<html><body>{inside}</body></html>") == WANT


@pytest.mark.parametrize("wrapper", ["<form id=f action='/post'>", "<div class='nav-fixed'>", "<div class='sidebar-layout'>", "<div class='search-results'>",
                                     "<div class='modal-open'>", "<div class='ad-free'>", "<div id='overlay'>", "<div role='search'>"])
@pytest.mark.parametrize("marked", (True, False))
def test_wrappers_of_the_whole_page_are_gone_into(wrapper, marked):
    end = "</form>" if wrapper.startswith("<form") else "</div>"
    article = ARTICLE if marked else "<div class='post'>" + "".join(f"<p>{p}</p>" for p in P) + "</div>"
    page = f"<html><body>{wrapper}{FURNITURE['menu']}{article}{FURNITURE['advert']}{FURNITURE['form']}{end}</body></html>"
    assert html_text.main_text(page) == (WANT if marked else "\n".join(P))


def test_unmarked_article_and_parts():
    page = "<body>" + "".join(FURNITURE.values()) + "<div class='post'>" + "".join(f"<p>{p}</p>" for p in P) + "</div></body>"
    assert html_text.main_text(page) == "\n".join(P)
    parts = "".join(f"<div><p>{p}</p><p>{p} again</p></div>" for p in (P[0], P[1], P[3]))
    want = "\n".join(x for p in (P[0], P[1], P[3]) for x in (p, p + " again"))
    assert html_text.main_text(f"<body>{FURNITURE['menu']}<div>{parts}</div></body>") == want


def test_references_white_space_and_broken_markup():
    text = "<article><p>a&amp;b &lt;p&gt; &#233;&nbsp;\n\t c</p><p><b>x<br>y<p>z <i>in</i>side</b><div>w</article>"
    assert html_text.main_text(f"<html><body>{text}") == "a&b <p> é c\nx y\nz inside\nw"
    assert html_text.main_text("just text, 1 < 2 & so on") == "just text, 1 < 2 & so on"
    assert html_text.main_text('<body><article title="a > b"><p title=\'it"s\'>one</p><!-- <p>no</p> --><p>two</p>') == "one\ntwo"
    assert html_text.main_text("<p>open <!-- never closed <p>x") == "open"
    assert html_text.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b\nc"
    assert html_text.main_text("</p></div><p>q</p></span") == "q"


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<nav>x</nav>", "<!-- x", "<", "</", "<a", "<script>x"])
def test_pages_without_text(page):
    assert html_text.main_text(page) in ("", "<")


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 60_000 + "<p>" + P[1] + "</p>" + "</span>" * 60_000
    assert html_text.main_text(f"<body>{deep}") == P[1]
    many = "".join(f"<p>{P[2]}<b>" for _ in range(60_000))
    assert html_text.main_text(f"<body><article>{many}").count("\n") == 59_999


def test_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, "u", ARTICLE, "old", 3), (1, "u", ARTICLE, "old", 3), (None, None, None, None, None), (2, "v", "<p>é</p>" * 20_000, "", 0)]
    df = spark.createDataFrame(rows, schema)
    out = sorted(((str(r.page_id), r.text) for r in html_text.extract(df).collect()), key=str)
    assert out == sorted([("1", WANT), ("1", WANT), ("None", ""), ("2", "\n".join("é" * 20_000))], key=str)
    assert html_text.extract(df.limit(0)).count() == 0

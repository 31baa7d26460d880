import html
import re

from packledger.llm import main_text, queries

TREE = main_text.trained()


def text(page):
    return main_text.main_texts([page], TREE)[0]


def test_tree_fits_its_examples():
    wrong = 0
    for page in main_text.PAGES:
        found = main_text.blocks(page)
        keep = TREE.predict(main_text.features(found))
        wrong += sum(k != (b.text[0] == "+") for k, b in zip(keep, found))
    assert wrong <= 2


def test_pages_against_their_article(prepared):
    pages = prepared.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split())
                 for x in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        expected[r["page_id"]] = "\n".join(p for p in parts if p)
    got = {r["page_id"]: r for r in queries.op3_main_text(prepared, "/root/testdata/sf0.01").collect()}
    assert {k: r["text"] for k, r in got.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


LONG = "The river rose over its banks in the night and the old bridge fell, so the town was cut off for a week."


def test_other_layouts():
    page = f"""<html><body class="has-sidebar"><header class="site"><a href=/>Home</a><h2>The Daily</h2></header>
    <div id="cookie-consent"><p>{LONG}</p><button>Fine</button></div>
    <div class=wrapper><main><h1>Flood &amp; fall</h1><p>{LONG}</p>
    <div class="ad-slot"><p>{LONG}</p></div><p>Second <a href="/x">link</a> para&shy;graph.<!-- <p>no</p> --><p>Third &lt;p&gt;
    <ul><li>One<li>Two</ul>
    <aside>{LONG}</aside><form><p>{LONG}</p><input value="x>y"><textarea>{LONG}</textarea></form></main>
    <div class="sidebar widget">{LONG}</div></div>
    <section id="comments"><article class="comment"><p>{LONG}</p></article></section>
    <footer>{LONG}</footer><script>if (a < b) document.write("<p>{LONG}</p>")</script></body></html>"""
    assert text(page) == f"Flood & fall\n{LONG}\nSecond link para\xadgraph.\nThird <p>\nOne\nTwo"


def test_names_of_adverts_on_the_frame_of_a_page():
    said = "The council will meet again on Monday to hear from the engineers who looked at what is left of the bridge."
    body = f"<h1>Flood</h1><p>{LONG}</p><p>{said}</p>"
    whole = f"Flood\n{LONG}\n{said}"
    menu, foot = "<nav><a href=/>Home</a></nav>", "<footer><p>All rights kept</p></footer>"
    for page in (
            f'<div class="overflow-hidden">{body}</div>',
            f'<div class="layout sidebar-right"><div class="story">{body}</div></div>',
            f'<form id="aspnetForm">{menu}{body}{foot}</form>',
            f'<form id="aspnetForm" method="post">{body}</form>',
            f'<article class="tags-page">{body}</article>',
            f'<article class="post sidebar-none">{body}</article>',
            f'<div class="hidden md:block">{menu}{body}</div>',
            f'<div class="post comments-open">{body}</div>',
            f'<div class="nav-open"><div class="ads-enabled">{menu}{body}{foot}</div></div>',
            f'<article><h1>Flood</h1><div class="search-history"><p>{LONG}</p></div><p>{said}</p></article>'):
        assert text(f"<html><body>{page}</body></html>") == whole, page


def test_marked_elements_stay_out_however_long():
    body = f"<h1>Flood</h1><p>{LONG}</p>"
    for name in ("advert", "sponsored", "cookie-notice", "newsletter-box", "sidebar", "share-buttons", "related-posts",
                 "search-box", "alert alert-info", "hidden", "comments", "comment-body", "popup"):
        beside = f'<div class="{name}">' + f"<p>{LONG} {LONG}</p>" * 3 + "</div>"
        assert text(f"<article>{body}</article>{beside}") == f"Flood\n{LONG}", name
        assert text(f"<article>{body}{beside}</article>") == f"Flood\n{LONG}", name
    cards = '<div class="related">' + f"<article><h3>More</h3><p>{LONG}</p></article>" + "</div>"
    assert text(f"<main>{body}<p>{LONG}</p><p>{LONG}</p></main>{cards}") == "\n".join(["Flood"] + [LONG] * 3)


def test_broken_markup():
    assert text(f"<p>{LONG}") == LONG
    assert text(f"<p>{LONG}<!-- never closed <p>{LONG}") == LONG
    assert text(f"<p>{LONG}<script>var x = 1;") == LONG
    assert text(f"<p title='a>b' x=\"1>2\">{LONG}</p></div></p></b>") == LONG
    assert text(f"<p>{LONG}</P ><STYLE>p{{}}</style ><p hidden>{LONG}</p>") == LONG
    assert text(f"<article><a href=x>{LONG}<p>{LONG} &#x41;&#66;&nbsp;&bogus;</article>") == f"{LONG}\n{LONG} AB &bogus;"
    for page in (None, "", "   ", "<", "<p", "<!--", "</", "<a href='", "plain", "<script>", "&", "<" * 1000):
        assert isinstance(text(page), str)
    assert text(None) == text("") == text("<nav>x</nav>") == ""


def test_very_long_page_is_read_whole():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert text(page) == "\n".join([LONG] * 20_000)
    assert text("<div>" * 50_000 + f"<p>{LONG}</p>") == LONG
    assert text("<div class=nav-open>" * 50_000 + f"<article><p>{LONG}</p></article>") == LONG


def test_odd_rows(prepared):
    kind = "page_id long, url string, html string, text int, n_chars string"
    pages = prepared.createDataFrame([(1, None, None, 1, "a"), (None, "u", f"<p>{LONG}</p>", None, None),
                                      (1, None, None, 1, "a"), (2, "v", "", None, None)], kind)
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in main_text.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "", 0), (1, None, "", 0), (2, "v", "", 0),
                                           (None, "u", LONG, len(LONG))], key=str)
    assert main_text.extract(prepared.createDataFrame([], kind)).count() == 0

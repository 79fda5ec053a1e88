import html
import re

import pytest

from leadloom.llm import html_extract
from leadloom.llm.html_extract import Page


@pytest.mark.parametrize("source,want", [
    ("", ""), ("plain  &amp; simple", "plain & simple"), ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
    ("<ul><li>one<li>two <b>x</b></ul>", "one\ntwo x"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<nav>menu</nav><article><h1>T</h1><p>x &eacute; &#233; &#x1F642;</p></article><footer>f</footer>", "T\nx é é 🙂"),
    ("<body>out<article>in<div class='ad-slot'>buy</div><aside>side</aside></article></body>", "in"),
    ("<div id=cookie-notice>c</div><form>f</form><p>text</p><!-- x <p>no</p> -->", "text"),
    ("<script>if(a<b) '</p>'</script><style>p{}</style><p>ok", "ok"), ("<article>a<article class=comment>b</article></article>", "a"),
    ("<p>a <span class='advert'>x</span>b</p>", "a b"), ("<p hidden>h</p><p style='display: none'>n</p><p>v", "v"),
    ("<header>top</header><main><header><h1>Head</h1></header>body</main>", "Head\nbody"), ("a < b and <3 <", "a < b and <3 <"),
    ("<article><p>t</article", "t"), ("<a href='x>y'>link</a> <A HREF=\"", "link"), ("</p></div><i>x</i>", "x"),
    ("<p>" + "<div>" * 3000 + "deep", "deep"), ("<!-- open", ""), ("<title>t</title><textarea>x</textarea>y", "y")])
def test_main_text(source, want):
    assert Page(source).text(frozenset()) == want


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")


def test_templates_of_a_host_are_deleted(spark):
    banner, rows = "<div><p>Read our <b>weekly</b>\n letter</p></div>", []
    for k in range(40):
        rows.append((k, f"http://a.com/{k}", f"<body>{banner}<div><p>page {k}</p></div><div><p>rare {k % 20}</p></div></body>"))
        rows.append((100 + k, f"http://b{k}.com/", f"<body>{banner}<p>page {k}</p></body>"))
        rows.append((200 + k, "http://c.com/", f"<article><p>same text</p><section>{banner}</section><p>page {k}</p></article>"))
    for most in (200_000, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, rows), broadcast_rows=most).collect()}
        for k in range(40):
            assert got[k] == f"page {k}\nrare {k % 20}"
            assert got[100 + k] == f"Read our weekly letter\npage {k}"
            assert got[200 + k] == f"same text\npage {k}"


def test_templates_equal_brute_force(spark):
    rows = [(k, f"http://h{k % 3}.com/", f"<!-- {k} --><div><i>{k % 2}</i></div><div>{k % 3}<p>{k % 7}</p></div>") for k in range(120)]
    counts = {}
    for k, url, source in rows:
        for h in set(html_extract.subtree_hashes(source)):
            counts[url[7:-1], h] = counts.get((url[7:-1], h), 0) + 1
    want = {(host, h, n) for (host, h), n in counts.items() if n >= 10 and n >= 0.3 * 40}
    assert want and {tuple(r) for r in html_extract.templates(frame(spark, rows), share=0.3).collect()} == want


def test_articles_of_the_test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        body = re.sub(r"</?b>", "", page["html"].split("<article>")[1].split("</article>")[0])
        blocks = [" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[page["page_id"]]["text"] == "\n".join(b for b in blocks if b) and got[page["page_id"]]["n_chars"] == len(got[page["page_id"]]["text"])


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", ""), (2, "http://h/", "<p>a</p>" * 50_000)]
    got = html_extract.extract(frame(spark, rows)).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got) == [0, 0, 0, 99_999]
    assert html_extract.extract(frame(spark, [])).collect() == []


def test_cards_are_not_the_text_and_recurring_articles_are_templates(spark):
    body = "the long running text of the page in a plain box with number"
    promo, rows = "<article><h2>Our club</h2><p>join us today for a year</p></article>", []
    for k in range(40):
        rows.append((k, f"http://a.com/{k}", f"<div id=content>{body} {k}</div><article>card {k}</article><article>card {k + 1}</article>"))
        rows.append((100 + k, f"http://b.com/{k}", f"<div>{promo}</div><article><h1>Title</h1><p>story {k}</p></article>"))
        rows.append((200 + k, f"http://c.com/{k}", f"<div><div class=x>story {k}</div></div>{promo}"))
        rows.append((300 + k, f"http://d.com/{k}", f"<nav>menu</nav><div>{promo}</div>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, rows)).collect()}
    for k in range(40):
        assert got[k] == f"{body} {k}\ncard {k}\ncard {k + 1}"
        assert got[100 + k] == f"Title\nstory {k}" and got[200 + k] == f"story {k}"
        assert got[300 + k] == "Our club\njoin us today for a year"


def test_rotating_boxes_of_a_large_host_are_templates(spark):
    """Boxes on a hundredth and a thirtieth of a host's pages, without telling names, go; so do they inside articles."""
    rows = [(k, "http://hot.com/", f"<div><p>offer <b>{k % 100}</b></p></div><article><div>see {k % 30}</div><p>often {k % 2}</p><p>page {k}</p></article>")
            for k in range(1200)]
    rows += [(9000 + k, "http://c.com/", "<div><p>a page</p><p>without article</p></div>") for k in range(20)]
    rows += [(5000 + k, "http://b.com/", f"<div>rare {k // 9}</div><p>page {k}</p>") for k in range(90)]
    for most in (200_000, 20, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, rows), broadcast_rows=most).collect()}
        assert [got.pop(9000 + k) for k in range(20)] == ["a page\nwithout article"] * 20
        assert got == {k: f"often {k % 2}\npage {k}" for k in range(1200)} | {5000 + k: f"rare {k // 9}\npage {k}" for k in range(90)}


@pytest.mark.parametrize("source,want", [
    ("<p>x</p><div class='ad' data-x=\"" + "y" * 12_000 + "a>b\">buy</div>z", "x\nz"),
    ("<div data-x='" + "y" * 2_000_000 + "a>b' class=ad>buy</div>z", "z"),
    ("<div class=ad title=\"open>buy</div>z", "z"), ("<p title=it's>don't</p>", "don't"),
    ("<p>x</p><div class=ad t=\"a>buy</div>z \"no end", "x\nz \"no end")])
def test_attribute_values_of_any_length(source, want):
    assert Page(source).text(frozenset()) == want


def test_many_open_quotes_take_linear_time():
    import time

    start = time.time()
    for piece in ("<a b=\">x", "<a b='>x", "<a b=c'd>x", "<a b=\"'>x"):
        Page(piece * 40_000)
    assert time.time() - start < 30


def test_names_never_remove_the_text_of_a_page():
    """An element with most of the words stays whatever it is called; a box of that name beside an article goes."""
    text = "<p>one two three four</p><p>five six</p>"
    for box in ("<article class='post social'>{}</article>", "<div class='content has-sidebar'>{}</div>", "<div class='post login-required'>{}</div>",
                "<form>{}</form>", "<main><div id='notice'>{}</div></main>", "<div class='comments'>{}</div>"):
        assert Page("<body>" + box.format(text) + "</body>").text(frozenset()) == "one two three four\nfive six"
        assert Page("<body><nav>a b c d e f g h i j</nav>" + box.format(text) + "</body>").text(frozenset()) == "one two three four\nfive six"
    long = "<p>" + "word " * 50 + "</p>"
    assert Page(f"<article>{text}</article><div class='comments'>{long}</div>").text(frozenset()) == "one two three four\nfive six"
    assert Page(f"<main><div>{text}</div><section class='comments'>{long}</section></main>").text(frozenset()) == "one two three four\nfive six"
    assert Page(f"<article>{text}</article><div class='sidebar'>{long}</div>").text(frozenset()) == "one two three four\nfive six"


def test_a_page_stored_often_keeps_its_text(spark):
    """Copies of a page are one page of their host; where all blocks recur, the article stays whole, boxes inside it too."""
    whole = "<article><h1>T</h1><p>one two three</p><div><p>four five</p></div></article>"
    boxed = "<body><article><div><p>one two</p><section>three</section></div></article></body>"
    rows = [(k, "http://a.com/x", whole) for k in range(12)] + [(100 + k, "http://b.com/x", boxed) for k in range(12)]
    rows += [(200 + k, "http://c.com/x", f"<body data-n={k}>{boxed[6:]}") for k in range(12)]
    for most in (200_000, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, rows), broadcast_rows=most).collect()}
        assert got == ({k: "T\none two three\nfour five" for k in range(12)} | {100 + k: "one two\nthree" for k in range(12)}
                       | {200 + k: "one two\nthree" for k in range(12)})

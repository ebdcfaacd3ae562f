"""Template extraction on pages of known content."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import sentence, tables
from tidemark.llm.extraction import domain, extract, in_order, main_blocks
from tidemark.llm.queries import QUERIES


def page(rng, n, marked=True):
    title, paragraphs = sentence(rng, "en", 5), [sentence(rng, "en", rng.randint(20, 60)) for _ in range(rng.randint(2, 6))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p} &amp; <b>so</b>\n on" for p in paragraphs)
    body = f"<article>{body}</article>" if marked else f"<div id=text>{body}</div>"
    html = (f"<!doctype html><html><head><title>{title}</title><style>p{{}}</style><script>if (a < b) x('</p>');</script></head>"
            "<body class='has-sidebar'><header><a href=/>Our paper</a></header><nav><ul><li>Home<li>News</ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div><div class=box>Always the same words here</div>{body}"
            f"<div class=sidebar>{sentence(rng, 'de', 9)}</div><form><label>Mail</label><input></form>"
            f"<section id=comments><article><p>{sentence(rng, 'de', 8)}</article></section><footer>&copy; n{n}</footer></body></html>")
    return html, "\n".join([title, *(f"{p} & so on" for p in paragraphs)])


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    return [page(rng, n, n % 2 == 0) for n in range(60)]


def test_main_text(spark, tmp_path, made):
    rows = [(n, f"http://{'a' if n % 2 else 'b'}.example/x/{n}", html, "x", "y", "z") for n, (html, _) in enumerate(made)]
    rows += [(100, None, None, None, None, None), (101, "no url", "", "", "", ""), (102, "http://a.example/", "plain &lt;text", "", "", ""),
             (103, "http://b.example/", "<article><p>cut off <b", "", "", ""), rows[0], rows[0]]
    sf_dir = tables(spark, str(tmp_path / "t"), pages=rows)
    found = QUERIES["op1_template_extraction"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    told = {r.page_id: r.text for r in found}
    assert {n: told[n] for n in range(60)} == {n: text for n, (_, text) in enumerate(made)}
    assert (told[100], told[101], told[102], told[103]) == ("", "", "plain <text", "cut off")
    assert all(r.n_chars == len(r.text) for r in found)


def test_empty_table(spark, tmp_path):
    assert QUERIES["op1_template_extraction"](spark, tables(spark, str(tmp_path / "e"), pages=[])).collect() == []


def test_identical_pages_keep_their_text(spark, made):
    rows = [(n, "http://a.example/", made[0][0]) for n in range(20)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {made[0][1]}


def test_longest_order():
    assert in_order([1, 5, 2, 3]) == {0, 2, 3}
    assert in_order([]) == set()


@pytest.mark.parametrize("html", [
    "<body><div id=page class='layout sidebar-right'>{nav}{body}{side}</div></body>",
    "<body><nav>Home</nav><article class='post social'>{body}</article>{side}</body>",
    "<body><form id=aspnetForm action=x>{nav}<div>{body}</div>{side}</form></body>",
    "<body><div class='search-page'><div class='widget'>{nav}<main>{body}</main>{side}</div></div></body>",
    "<body><div class='page sidebar-right'>{nav}{body}<div id=comments>{long}</div></div></body>",
    "<body>{nav}<div>{body}</div><div class=comments>{long}</div></body>",
    "<body>{nav}{body}<article class='comment'><p>{long}</article></body>",
])
def test_a_class_name_drops_no_article(html):
    parts = {"nav": "<div class=menu><a href=/>Home</a> <a href=/n>News</a></div>", "body": "<h1>The title</h1><p>One two three four.<p>Five <a href=x>six</a> seven eight.",
             "side": "<div class=sidebar>Other pages</div>", "long": "A comment that is longer than the page. " * 20}
    assert "\n".join(b["text"] for b in main_blocks(html.format(**parts), {})) == "The title\nOne two three four.\nFive six seven eight."


def test_a_page_of_dropped_names_keeps_its_text():
    assert [b["text"] for b in main_blocks("<div class=promo>One</div><div class=share>Two</div><script>x</script>", {})] == ["One", "Two"]
    assert main_blocks("<nav>Home</nav><div hidden>x</div>", {}) == []


def test_small_hosts_have_templates(spark, made):
    hosts = [*["three.example"] * 3, *["seven.example"] * 7, "a.small.example", "b.small.example:80", "c.small.example", "c.small.example",
             "www.one.co.uk", "www.two.co.uk", "alone.example"]
    rows = [(n, f"http://{host}/{n}", made[2 * n][0]) for n, host in enumerate(hosts)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    # the last three are alone; marked articles tell their text all the same
    assert {r.page_id: r.text for r in found} == {n: made[2 * n][1] for n in range(len(hosts))}
    rows = [(n, f"http://{host}/{n}", made[2 * n + 1][0]) for n, host in enumerate(hosts)]
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {n: found[n] for n in range(14)} == {n: made[2 * n + 1][1] for n in range(14)}
    assert all(found[n] == f"Always the same words here\n{made[2 * n + 1][1]}" for n in range(14, 17))


def test_registered_domains(spark):
    names = {"a.b.example.com": "example.com", "example.com": "example.com", "x.shop.co.uk": "shop.co.uk", "shop.co.uk:8080": "shop.co.uk",
             "u:p@www.x.de": "x.de", "10.1.2.3:80": "10.1.2.3", "localhost": "localhost", "": ""}
    df = spark.createDataFrame([(n,) for n in names], "host string")
    assert {r.host: r.name for r in df.select("host", domain(F.col("host")).alias("name")).collect()} == names


def test_a_quote_opens_a_value_only_after_an_equals_sign():
    from tidemark.llm import markup

    page = "<main><p>one</p><a title=it's href=x>link</a><p>two</p><p>I don't know.</p><p title = 'a > b' x=\"it's >\">three</p></main>"
    assert [b.text for b in markup.blocks(markup.read(page))] == ["one", "link", "two", "I don't know.", "three"]


def test_deep_pages_are_tracked_to_the_bottom():
    from tidemark.llm import markup

    page = "<div>" * 600 + "<nav><p>menu</p></nav><p>text</p>" + "</div>" * 600
    assert [(b.text, b.dropped) for b in markup.blocks(markup.read(page))] == [("menu", True), ("text", False)]

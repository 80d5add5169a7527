"""Main text of pages: generated sites with a known article, and odd markup."""

import random
import re

from lexspark.llm import main_text
from lexspark.llm.main_text import extract

SCHEMA = "page_id long, url string, html string"


def sentence(rng, n=None):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n or rng.randint(8, 40)))


def marked(rng, body):
    menu = "".join(f"<li><a href='/{i}'>{sentence(rng, 1)}</a></li>" for i in range(rng.randint(3, 6)))
    text = "".join(f"<p>{b}" + rng.choice(["</p>", ""]) for b in body[1:])
    return (
        f"<!DOCTYPE html><html><head><title>{body[0]}</title><style>p{{x:'</p>'}}</style></head><body><header class=top>{sentence(rng, 3)}</header><nav><ul>{menu}</ul></nav>"
        f"<div class='cookie-notice'>{sentence(rng)}</div><main><article><header><h1>{body[0]}</h1></header>{text}<aside>{sentence(rng)}</aside></article>"
        f"<section id=comments><article class=comment><p>{sentence(rng)}</article></section></main>"
        f"<form><label>Mail</label><input></form><script>var a = '<p>no</p>';</script><footer>&copy; {sentence(rng, 4)}</footer></body></html>"
    )


def unmarked(rng, body):
    """Nothing says what is what: only comparing pages tells the fixed blocks from the article."""
    fixed = "<div class=x1><div>Welcome to our site of all things</div><div>Call us any time of the day</div></div>"
    menu = "<div class=x2>" + "".join(f"<div><a href=/{i}>{sentence(rng, 2)}</a></div>" for i in range(rng.randint(3, 6))) + "</div>"
    text = "".join(f"<div>{b}</div>" for b in body)
    return f"<html><body>{fixed}{menu}<div class=x3>{text}<div>Thanks for reading this far</div></div><div class=x4>All rights are ours {sentence(rng, 2)}</div></body></html>"


def site(seed, shape, n, host):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        body = [sentence(rng, 6), *(sentence(rng) for _ in range(rng.randint(3, 9)))]
        rows.append((seed * 1000 + i, f"http://{host}/{i}", shape(rng, body)))
        truth[seed * 1000 + i] = "\n\n".join(body)
    return rows, truth


def found(spark, rows, schema=SCHEMA):
    return {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, schema).repartition(3)).collect()}


def test_sites_with_and_without_marks(spark):
    a, ta = site(1, marked, 12, "one.example")
    b, tb = site(2, unmarked, 12, "TWO.example:8080")
    c, tc = site(3, marked, 1, "three.example")
    assert found(spark, a + b + c) == ta | tb | tc


def test_template_needs_the_other_pages(spark):
    rows, truth = site(4, unmarked, 9, "four.example")
    alone = [(i, f"http://h{i}.example/", h) for i, _, h in rows]
    got = found(spark, alone)
    assert all("Thanks for reading" in got[i] and "Thanks for reading" not in truth[i] for i in truth)


def test_copies_of_one_page_are_no_template(spark):
    rows, truth = site(5, unmarked, 1, "five.example")
    copies = [(i, "http://five.example/same", rows[0][2]) for i in range(40)]
    for text in found(spark, copies).values():
        assert truth[5000] in text


def test_near_copies_of_an_article_stay_whole(spark):
    rows, truth = site(6, marked, 1, "six.example")
    page, text = rows[0][2], truth[6000]
    last = text.split("\n\n")[-1]
    near = [(i, "http://six.example/", page.replace(last, f"{last} {i}")) for i in range(20)]
    assert found(spark, near) == {i: text.replace(last, f"{last} {i}") for i in range(20)}


def test_markup_of_all_kinds():
    for html, want in {
        None: "",
        "": "",
        "just text &amp; &lt;more&gt; &nbsp; here": "just text & <more> here",
        "<p>one<br>two &#233;&eacute;<p><b>three": "one two éé\n\nthree",
        "<p>a < b and c > d</p><p>x</p": "a < b and c > d\n\nx",
        "<p>&amp;lt;</p>": "&lt;",
        "<!-- <p>no</p> --><p>yes</p><!-- open <p>no": "yes",
        "<SCRIPT>'<p>no</p>'</SCRIPT ><P CLASS=\"a>b\">yes</P>": "yes",
        "<table><tr><td>a</td><td>b</td></tr><tr><th>c</table>": "a b\n\nc",
        "<ul><li>a<li>b</ul>": "a\n\nb",
        "<form><p>only a form</p></form>": "only a form",
        "<div data-class=nav>kept</div>": "kept",
        "<p>in <span class=ad>buy</span> line</p>": "in\n\nline",
        "<article><p>t</p></article><div role='contentinfo'>no</div><div class='siteFooter'>no</div>": "t",
        "<article>a</article>" + "<div>" * 3000 + "deep": "a",
    }.items():
        assert extract(html, set(), set()) == want, html


def test_nulls_repeats_names_and_empty(spark):
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 1), (2, "not a url", "<p>a</p>", "y", 2), (None, "http://h/", "", "z", 3)]
    out = main_text.main_text(spark.createDataFrame(rows, SCHEMA + ", `a.host` string, mains int"))
    assert out.columns == ["page_id", "url", "html", "a.host", "mains", "text"]
    assert sorted((str(r.page_id), r.text, r["a.host"], r.mains) for r in out.collect()) == [("1", "", "x", 1), ("1", "", "x", 1), ("2", "a", "y", 2), ("None", "", "z", 3)]
    assert main_text.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_pages_against_their_article(spark):
    """The given pages have one article each, of headings and paragraphs."""
    import html

    from lexspark.llm.queries import op12_pages

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in op12_pages(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", article))
        text = "\n\n".join(b for b in blocks if b)
        assert got[i] == (text, len(text))

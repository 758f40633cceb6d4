"""Main text of pages: any markup in linear time, no prose of an article lost, whole generated sites block by block."""

import random
import time

import pytest

from setcast.llm import html

PROSE = "Some long prose of the story. " * 20


@pytest.mark.parametrize("piece", ["<a ", "<!--", "<![", "</a", '<a b="', "<a b='", "&#", "&#9", "&#x0", "<", "<script>", "</script", "<div class='ad'>", "<p>", "<b>", "<a b=\"x' ", "<br/", "<!-->"])
def test_a_megabyte_of_unfinished_markup(piece):
    page, began = "<p>text</p>" + piece * (1_000_000 // len(piece)), time.process_time()
    assert html.extract(page, None).startswith("text")
    assert time.process_time() - began < 4


def test_no_page_fails():
    r = random.Random(1)
    pieces = ["<", "</", ">", "<!", "<!--", "-->", "<![CDATA[", "]]>", "<?", "a", "div", "p", " class=", "'", '"', "ad", "article", "body", "=", "/", "&", "&#", "&#x", "9" * 5000, "f;", "amp;", " ", "\n", "script", "é", "table", "td", "li", "h1", "form", "section", "nav", "main", "title", "textarea", "\0"]
    for _ in range(10_000):
        page = "".join(r.choice(pieces) for _ in range(r.randrange(60)))
        assert isinstance(html.extract(page, None), str) and isinstance(html.extract(page, [">body", ">div"]), str)


def test_declarations_comments_and_references():
    for odd in ("<![ x", "<![?>", "<![1]>", "<![x[y]]>", "<![-- c -->", "<!-- <p>no</p> -->", "<!doctype", "<?php x ?>", "</>", "</ x>", "<!-->"):
        assert html.extract("<p>text</p>" + odd, None) == "text", odd
    assert html.extract("<p>1 < 2 <3 &lt; &#65;&#x42;&#0000000000067; &#99999999999; &nosuch; &copy &eacute;</p>", None) == "1 < 2 <3 < ABC � &nosuch; © é"
    assert html.extract("<p title='a > b' class=x>in</p><SCRIPT>var a='<p>no</p>';</script ><p>out</p><style/><p>more</p>", None) == "in\n\nout\n\nmore"


@pytest.mark.parametrize(
    "inner",
    ["<div class=warning><p>Be careful with this.</p></div>", "<p class=search>The search went on for days.</p>", "<section class=related><p>Related prose stays here.</p></section>", "<p id=share>Share this finding.</p>", "<p class=notice>Take notice of that.</p>", "<p class=disclaimer>No promise is made.</p>", "<p>x <math><mi>y</mi></math> z.</p>"],
)
def test_names_hide_no_prose_of_an_article(inner):
    for around in ("<body><article><h1>T</h1><p>{}</p>{}</article>", "<body><div class=c><h1>T</h1><p>{}</p>{}</div>"):
        got = html.extract(around.format(PROSE, inner), None).split("\n\n")
        assert got[:2] == ["T", PROSE.strip()] and len(got) == 3


def test_what_stands_beside_the_region():
    assert html.extract(f"<body><div class=wrap><div class=a><p>{PROSE}</p></div><div class=b>tiny end.</div></div>", None).endswith("\n\ntiny end.")
    got = html.extract(f"<body><h1>Head</h1><div class=text><p>{PROSE}</p></div><p>Closing words.</p><footer>f</footer><div>© 2020 All of us.</div>", None)
    assert got.split("\n\n") == ["Head", PROSE.strip(), "Closing words."]
    got = html.extract(f"<body><h1>Head</h1><nav>n</nav><article><p>{PROSE}</p><div class=share><a>fb</a> <a>tw</a></div><div class=comments><p>hi there you all.</p></div></article><div>Foot words.</div>", None)
    assert got.split("\n\n") == ["Head", PROSE.strip()]


def test_generated_sites_block_by_block(spark):
    """Hosts with templates of their own; every block of every article is known."""
    r, rows, want = random.Random(7), [], {}
    sentence = lambda: " ".join(r.choice("lorem ipsum dolor sit amet of the and in".split()) for _ in range(r.randrange(4, 30))).capitalize() + r.choice(".!?")
    open_close = [("<article>", "</article>"), ("<main><div class=wrap>", "</div></main>"), ("<div class='post p{k}'>", "</div>"), ("<section id=s{k}><article class=text>", "</article></section>"), ("<form><div class=content>", "</div></form>")]
    before = ["<nav><ul><li><a href=/>Home</a></ul></nav>", "<header><h1>Site</h1></header>", "<div class=cookie-notice>We use cookies.</div>", "<div class=ad>Buy now.</div>", "<aside>Side words here.</aside>", "<script>var x='<p>';</script>"]
    after = ["<footer>&copy; Site</footer>", "<div id=comments><p>First comment here.</p></div>", "<div class=sidebar><p>About us all.</p></div>", "<div class='newsletter'>Sign up now.</div>", "<form><input><p>Send it.</p></form>", "<div class=related><a href=/>One</a> <a href=/>Two</a></div>"]
    for k in range(120):
        host, blocks, body = k % 10, [sentence().strip(".!?")], ""
        body += f"<h1>{blocks[0]}</h1>"
        for _ in range(r.randrange(2, 12)):
            text = sentence()
            kind = r.randrange(6)
            body += [f"<p>{text}</p>", f"<p>{text}", f"<blockquote><p>{text.replace(' ', '  ' + chr(10))}</p></blockquote>", f"<ul><li>{text}</ul>", f"<div class=part><p>{text}</p></div>", f"<p><b>{text[:3]}</b>{text[3:]}<!-- no --></p>"][kind]
            blocks.append(text)
        left, right = open_close[host % 5]
        page = "<html><head><title>t</title></head><body>" + "".join(r.sample(before, 3)) + left.format(k=k) + body + right + "".join(r.sample(after, 3)) + "</body></html>"
        rows.append((k, f"https://h{host}.example/{k}", page))
        want[k] = "\n\n".join(blocks)
    got = {x["page_id"]: x["text"] for x in html.op8(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}

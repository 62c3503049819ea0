"""Main text of pages: planted articles in many layouts, markup cases, and the table against a plain reading of its one layout."""

import html
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import pages, queries
from tests.conftest import DATA

WORDS = "river stone harbour lantern meadow winter copper signal orchard velvet thunder garden marble compass ribbon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def boilerplate(rng):
    """Parts of pages that are no article, by name."""
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 6))
    return {
        "menu": f"<nav><ul>{links}</ul></nav>",
        "menu by class": f'<div class="main-menu"><ul>{links}</ul></div>',
        "plain menu": f"<ul>{links}</ul>",
        "header": f"<header><h2>{sentence(rng, 3)}</h2><p>{sentence(rng, 30)}</p></header>",
        "footer": f"<footer><p>&copy; {sentence(rng, 40)}</p></footer>",
        "footer by class": f'<div id="page-footer">{sentence(rng, 30)}</div>',
        "sidebar": f"<aside><h3>More</h3><p>{sentence(rng, 50)}</p></aside>",
        "sidebar by class": f'<div class="left sideBar"><p>{sentence(rng, 50)}</p></div>',
        "notice": f'<div class="cookie-notice" role="dialog"><p>{sentence(rng, 45)}</p><button>OK</button></div>',
        "advert": f'<div class="ad">{sentence(rng, 20)}</div><!-- ad -->',
        "form": f'<form><label>{sentence(rng, 9)}</label><input value="x"><textarea>{sentence(rng, 30)}</textarea><select><option>a<option>b</select></form>',
        "script": '<script>var t="</p><p>one two three four";</script><style>p{margin:0}</style><noscript>Enable it</noscript><template><p>no</p></template>',
        "comments": "<section id='comments'><h2>Comments</h2>" + "".join(f'<article class="comment"><p>{sentence(rng, 60)}</p></article>' for _ in range(4)) + "</section>",
        "hidden": f"<div hidden><p>{sentence(rng, 40)}</p></div><div style='DISPLAY : none'>{sentence(rng, 40)}</div><p aria-hidden=\"true\">{sentence(rng, 40)}</p>",
    }


def article(rng):
    """Blocks of an article, and their markup."""
    blocks, marked = [sentence(rng, 6)], []
    marked.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randint(3, 9)):
        n = rng.choice([1, 8, 40, 90])
        text = sentence(rng, n)
        kind = rng.randrange(6)
        if kind == 0:
            blocks += (items := [sentence(rng, 12) for _ in range(3)])
            marked.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            continue
        inner = text
        if kind == 1:
            a, b = text.split(" ", 1) if " " in text else (text, "")
            inner, text = f"<b>{a}</b>&amp;&nbsp;\n  <i>{b}</i>", f"{a}& {b}".strip()
        if kind == 2:
            inner, text = f'see <a href="#x">{text}</a><br>and on', f"see {text} and on"
        tag = rng.choice(["p", "blockquote", "h2"]) if kind == 3 else "p"
        blocks.append(text)
        marked.append(f"<{tag}>{inner}</{tag}>" if tag != "p" or kind != 4 else f"<p>{inner}")
    return blocks, "".join(marked)


LAYOUTS = {
    "article": "{before}<article>{body}</article>{after}",
    "main": "{before}<main><div>{body}</div></main>{after}",
    "article in main": "{before}<main><article><div class='post'>{body}</div></article>{after}</main>",
    "role": "<div>{before}</div><div role='main'>{body}</div>{after}",
    "own header and footer": "{before}<article><header class='post-header'>{body}</header><footer>{tail}</footer></article>{after}",
    "div": "<div id='top'>{before}</div><div class='x1'><div class='x2'>{body}</div></div><div class='x3'>{after}</div>",
    "wrapper": "<div class='page has-sidebar'>{before}<div id='content'>{body}</div>{after}</div>",
    "flat": "{before}{body}{after}",
    "table": "<table><tr><td>{before}</td><td>{body}</td></tr></table>{after}",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_planted_articles(layout):
    rng = random.Random(layout)
    for _ in range(60):
        blocks, body = article(rng)
        parts = boilerplate(rng)
        before, after = rng.sample(sorted(parts), 4), rng.sample(sorted(parts), 4)
        page = LAYOUTS[layout].format(before="".join(parts[k] for k in before), body=body, after="".join(parts[k] for k in after), tail=sentence(rng, 30))
        found = pages.main_blocks(f"<!DOCTYPE html><html><head><title>{blocks[0]}</title></head><body>{page}</body></html>")
        assert found == blocks, (before, after)


CASES = {
    "": [],
    " \n ": [],
    "just text\n with   lines": ["just text with lines"],
    "<p>one<p>two": ["one", "two"],
    "<p>a<b>b</b>c <i> d </i></p>": ["abc d"],
    "<p>one<br>two</p>": ["one two"],
    "<p>&lt;tag&gt; &eacute; &#233; &#x1F600; &amp &nosuch; &am</p>": ["<tag> é é \U0001f600 & &nosuch; &am"],
    "<article><p>text that a page cuts o": ["text that a page cuts o"],
    "<article><p>text that</p><p clas": ["text that"],
    "<article><p>text</p><!-- never ends <p>no</p>": ["text"],
    "<article><p>x</p><script>var a = '<p>y</p>'": ["x"],
    "<article><p>a <span class='ad'>buy</span> b</p></article>": ["a b"],
    "<p>x</p><![if IE]><p>y</p><![endif]><?php z ?>": ["x", "y"],
    "<article><p>a</div></p></section>b</article></article>": ["a", "b"],
    "<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl></article>": ["a", "b", "c", "d", "e"],
    "<nav><a href=x>only</a></nav>": [],
    "<div class='notice'><p>nothing else is there</p></div>": ["nothing else is there"],
    "<article><p>퟿ ​w</p></article>": ["퟿ ​w"],
    "<main><h1>Title</h1><article><p>text of the article</p></article></main>": ["Title", "text of the article"],
}


@pytest.mark.parametrize("page", CASES)
def test_markup(page):
    assert pages.main_blocks(page) == CASES[page]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> </div> <a> </a> <b> <br> <li> <ul> </ul> <td> <table> </table> <article> </article> <nav> </nav> <!-- --> <![ ]]> <script> </script> < > </ & &amp; &#1; ' \" = x y".split() + [" ", "\x00", "é"]), max_size=60))
def test_any_markup(parts):
    """No input fails, and no block has markup's white space at its ends or is empty."""
    for block in pages.main_blocks("".join(parts)):
        assert block and block == " ".join(block.split())


@pytest.mark.parametrize("part", ["<", "<a ", "<!--", "</", "&", '<a x="', "<p>", "<div>", "<![CDATA[", "<?", "<b>", "</p>", "&#", "<td>", "<li>"])
def test_long_pages(part):
    """Pages of a million characters of one thing end, with what stands before."""
    assert pages.main_blocks("<article><p>start of it</p></article>" + part * (1_000_000 // len(part)))[0] == "start of it"


def test_long_text_is_whole(spark):
    text = "word " * 400_000
    assert pages.main_blocks(f"<article><p>{text}</p></article>") == [text.strip()]


def plain(page):
    """The only layout of the table, read with expressions."""
    body = re.split(r"<article>|</article>|<footer>", page)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_the_query(spark):
    got = {r.page_id: r for r in queries.op13_html_text(spark, DATA).collect()}
    table = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(table)
    for r in table:
        assert (got[r.page_id].url, got[r.page_id].text) == (r.url, plain(r.html))
        assert got[r.page_id].n_chars == len(got[r.page_id].text) > 0


def test_rows(spark):
    """Null pages and ids, repeated rows, extra columns, an empty table."""
    df = spark.createDataFrame([(1, "u", None, "b"), (1, None, "<p>x", "b"), (1, None, "<p>x", "b"), (None, "v", "", "b")], "page_id long, url string, html string, blocks string")
    assert sorted((r.page_id or 0, r.blocks) for r in pages.extract(df).collect()) == [(0, []), (1, []), (1, ["x"]), (1, ["x"])]
    assert pages.extract(df.limit(0)).collect() == []

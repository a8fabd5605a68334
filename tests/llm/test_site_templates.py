"""Main texts: page by page against plain readings, and across the pages of a host."""

import html
import re
from collections import defaultdict

import pytest

from ruleloom.llm.html_tree import page_blocks
from ruleloom.llm.site_templates import main_text


def texts(source):
    return [t for t, _ in page_blocks(source)[2]]


@pytest.mark.parametrize("source, blocks", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("<p>one<p>two</p>three", ["one", "two", "three"]),
    ("<p><b>one<br>two<p>three</b> four", ["one two", "three four"]), ("a<b>b</b>c <i> d</i>", ["abc d"]),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", ["x", "y", "z"]), ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
    ("a &lt;b&gt; &amp;amp; &#233;&nbsp;&eacute; &am &amp", ["a <b> &amp; é é &am &"]), ("1 < 2 > 1 <3", ["1 < 2 > 1 <3"]),
    ("x<!-- <p>no</p> -->y<!---->z<!-- open <p>", ["xyz"]), ("<p title='a>b' class=\"c>d\">x</p><p title=it's>y</p>", ["x", "y"]),
    ('<script>var t="</p><p>no";</script>yes<SCRIPT>no</script >too<script>open', ["yestoo"]), ("<p>cut <b", ["cut"]), ("<p>cut </", ["cut"]),
    ("<title>no</title><style>p{}</style><h1>yes", ["yes"]), ("<div><div>a</div></p></span>b</div>c", ["a", "b", "c"]),
    ("<nav><p>menu</nav><div class='x Site-Sidebar'>no</div><p id=cookie-notice>no<p>yes<form>no</form>", ["yes"]),
    ("<header><h1>site</h1></header><article><header><h1>head</h1></header><p>text<footer>no</footer></article>", ["head", "text"]),
    ("<div class=has-sidebar><main>kept<div class=comments><article>reader</article></div></main></div>", ["kept"]),
    ("<article>post</article><section id=comments><article>reader</article></section>", ["post"]),
    ("<div class='page with widgets'><div class=menu>no</div><article>post</article></div>", ["post"]),
    ("<div role=navigation>no</div><div hidden>no</div><div style='display: none'>no</div><pre>code <span class=ad>no</span>x</pre>", ["code x"]),
    ("<h1>a<h2>b</h3>c", ["a", "b", "c"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("<![CDATA[x]]>y<?php z ?>w", ["yw"]),
])
def test_blocks(source, blocks):
    assert texts(source) == blocks


def test_deep_and_long_pages():
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000 + "after") == ["deep", "after"]
    assert texts("<b><p>" * 2000 + "x") == ["x"]
    assert len(texts("<p>word word</p>" * 20_000)) == 20_000
    assert texts("<a b='" * 3000) == [] and texts("<" * 100_000) == ["<" * 100_000]


KIND = "page_id long, url string, html string, host string, text string, story long, blocks string"


def run(spark, rows):
    found = main_text(spark.createDataFrame([(*r, None, "clash", 1, "x") for r in rows], KIND).repartition(3)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    got = defaultdict(list)
    for r in found:
        got[r["page_id"]].append(r["text"])
    return got


def test_templates_go_and_shared_passages_stay(spark):
    def page(n, extra="", title=None):
        return (
            f"<div><div>All of {('red', 'blue')[n % 2]} things</div><p>Only here {n}</p></div>"
            f"<article><h1>{title or f'Title {n}'}</h1><p>A passage that many quote.</p><div>Read more on this site</div>{extra}<div>Own {n}</div></article>"
        )

    rows = [(n, f"https://User@Site.example:80/{n}?a=b", page(n)) for n in range(20)]
    rows += [(100 + n, "http://other.example", page(n)) for n in range(4)]
    rows += [(200 + n, f"http://copies.example/{n}", page(1, f"<p>{n}</p>", "Same")) for n in range(30)]
    rows += [(300 + n, None, page(n)) for n in range(8)]
    got = run(spark, rows)
    assert got[3] == ["Only here 3\nTitle 3\nA passage that many quote.\nOwn 3"]
    whole = "All of blue things\nOnly here 3\nTitle 3\nA passage that many quote.\nRead more on this site\nOwn 3"
    assert got[103] == [whole] and got[303] == [whole]
    assert got[207] == ["All of blue things\nOnly here 1\nSame\nA passage that many quote.\nRead more on this site\n7\nOwn 1"]


def test_a_template_is_recurrent_by_share(spark):
    rows = [(n, "http://big.example/", f"<p>{'quoted five times' if n < 5 else 'alone'} </p><p>{n} {'x' * 30}</p>") for n in range(600)]
    rows += [(1000 + n, "http://small.example/", f"<p>quoted five times</p><p>{n} {'x' * 30}</p>") for n in range(5)]
    got = run(spark, rows)
    assert got[2] == ["quoted five times\n2 " + "x" * 30] and got[1002] == ["2 " + "x" * 30]
    assert got[77] == ["77 " + "x" * 30]


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a.example", "<p>x"), (3, "no url", "<p>y</p>"), (3, "no url", "<p>y</p>")]
    rows += [(4, "http://a.example", "<p>" + "long text " * 100_000), (5, "http://a.example", "<nav>menu</nav>")]
    got = run(spark, rows)
    assert (got[1], got[2], got[None], got[3], got[5]) == ([""], [""], ["x"], ["y", "y"], [""])
    assert len(got[4][0]) == 999_999
    assert run(spark, []) == {}


def test_the_tables_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for page in pages.collect():
        body = re.search("<article>(.*?)(</article>|$)", page["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</h1>|</?p>", body))
        assert got[page["page_id"]] == "\n".join(b for b in blocks if b)
    assert len(got) == pages.count()

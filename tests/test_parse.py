import pytest

from skerry.operators.html import parse_html
from skerry.operators.markdown import parse_markdown

PAGE = """---
title: "Handbook"
---
import Card from 'x'

# Billing

Money matters.

## Refunds

<Card>

Within 30 days.

- one
- two

### International

Slower.

## Fees

None.
"""


def test_blocks_point_into_the_source_and_carry_their_path():
    got = parse_markdown(PAGE)
    assert got["title"] == "Handbook"
    assert all(got["text"][b["char_start"] : b["char_end"]] == b["text"] for b in got["blocks"])
    assert [(b["heading_path"], b["text"].split("\n")[0]) for b in got["blocks"]] == [
        ([], "Money matters."),
        (["Refunds"], "Within 30 days."),
        (["Refunds"], "- one"),
        (["Refunds", "International"], "Slower."),
        (["Fees"], "None."),
    ]


def test_skipped_levels_stay_dense_and_close():
    got = parse_markdown("## A\n\nw\n\n#### B\n\nx\n\n### C\n\ny\n\n## D\n\nz")
    assert [b["heading_path"] for b in got["blocks"]] == [["A"], ["A", "B"], ["A", "C"], ["D"]]


def test_empty_heading_closes_but_opens_nothing():
    got = parse_markdown("## A\n\nw\n\n##\n\nx")
    assert [b["heading_path"] for b in got["blocks"]] == [["A"], []]


def test_setext_later_h1_and_markup_in_headings():
    got = parse_markdown("Title *here*\n===\n\na\n\n# Second `code`\n\nb")
    assert got["title"] == "Title here"
    assert [b["heading_path"] for b in got["blocks"]] == [[], ["Second code"]]


@pytest.mark.parametrize("noise", ["export const a = 1", "<Tabs>text", "<div>\nx\n</div>", "<!-- gone -->"])
def test_noise_is_dropped(noise):
    assert [b["text"] for b in parse_markdown(f"{noise}\n\nkept")["blocks"]] == ["kept"]


def test_fences_hide_headings_and_lists_keep_loose_items():
    got = parse_markdown("```\n# no\n```\n\n1. a\n\n   b\n2. c\n\nafter")
    assert [b["text"] for b in got["blocks"]] == ["```\n# no\n```", "1. a\n\n   b\n2. c", "after"]


HTML = """<html><head><title>Tab</title></head><body><nav>menu</nav><main><header><h1>Page</h1></header>
<ul><li><a href="#a">A</a></li><li><a href="#b">B</a></li></ul>
<h2 id="a">Part<a href="#a">¶</a></h2><p>See <a href="/x?q=1">this</a>.</p><img alt="a chart" src="c.png"><script>no()</script><aside>side</aside></main><footer>foot</footer></body></html>"""


def test_html_keeps_content_and_drops_furniture():
    got = parse_html(HTML, "https://e.org/dir/page")
    assert got["title"] == "Page"
    assert [(b["heading_path"], b["text"]) for b in got["blocks"]] == [(["Part"], "See [this](https://e.org/x?q=1)."), (["Part"], "a chart")]
    assert all(got["text"][b["char_start"] : b["char_end"]] == b["text"] for b in got["blocks"])


def test_unmarked_page_loses_its_link_list_and_takes_the_tab_title():
    html = "<title>T</title><body><header>h</header><div><a href=a>Documentation</a><a href=b>Blog posts</a><a href=c>Pricing</a></div><p>Real text of the page.</p></body>"
    got = parse_html(html)
    assert got["title"] == "T" and [b["text"] for b in got["blocks"]] == ["Real text of the page."]


def test_root_choice_prefers_main_then_article_then_role():
    html = "<article>art</article><div role=main>role</div><main>main</main>"
    assert parse_html(html)["text"] == "main"
    assert parse_html(html.replace("main>", "x>"))["text"] == "art"
    assert parse_html("<div role=main>role</div><p>rest</p>")["text"] == "role"


def test_parse_documents_keeps_columns_and_dispatches(spark):
    from skerry.operators.parse import blocks, parse_documents

    rows = spark.createDataFrame(
        [("1", "a.md", "<h1>T</h1>x", {"contentType": "text/html"}), ("2", "b.html", "<p>y</p>", {}), ("3", "c", None, None), ("4", "d", " <!DOCTYPE html><p>z", {})], "id string, uri string, text string, metadata map<string,string>"
    )
    out = parse_documents(rows)
    assert out.columns == ["id", "uri", "text", "metadata", "parsed"]
    got = {(r["id"], r["text"]) for r in blocks(out).collect()}
    assert {("2", "y"), ("4", "z")} <= got and not any(i == "3" for i, _ in got)
    assert out.where("id = '1'").first()["parsed"]["title"] == "T"

import os

import pytest

from skerry.sources import Response, UrlOptions, load_corpus, load_files, load_urls
from skerry.sources.files import common_root
from skerry.sources.urls import _attempts


def tree(root):
    for name, body in {
        "start.md": "# Harbour", "shore/tide-tables.md": "text", "shore/far/out/chart.html": "<p>x", "shore/log.txt": "n", "map.pdf": "p", ".keys": "s", ".store/old.md": "c", "node_modules/lib/about.md": "m",
        "shore/long.md": "b" * 300, "shore/odd [1].md": "odd", "raw.txt": "a\x00b", "LICENSE.md": "l",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    os.symlink(root / "start.md", root / "alias.md")


def test_folder_scan(spark, tmp_path):
    tree(tmp_path)
    docs, failed = load_files(spark, str(tmp_path), namespace="acme", max_bytes=200)
    rows = docs.collect()
    assert [r["uri"] for r in rows] == ["LICENSE.md", "shore/far/out/chart.html", "shore/log.txt", "shore/odd [1].md", "shore/tide-tables.md", "start.md"]
    assert {r["uri"]: r["title"] for r in rows}["shore/tide-tables.md"] == "tide tables"
    reasons = {r["uri"]: r["reason"] for r in failed.collect()}
    assert reasons["alias.md"] == "symbolic link skipped" and reasons["shore/long.md"] == "file is 300 bytes, over the 200 byte limit" and reasons["raw.txt"] == "looks like a binary file"
    assert len(rows[0]["id"]) == 16 and len(rows[0]["content_hash"]) == 64


def test_named_files_roots_and_missing(spark, tmp_path):
    tree(tmp_path)
    docs, failed = load_files(spark, [str(tmp_path / "map.pdf"), str(tmp_path / "nothing.md")])
    assert [r["uri"] for r in docs.collect()] == ["map.pdf"] and [r["uri"] for r in failed.collect()] == ["nothing.md"]
    assert common_root([str(tmp_path / "shore/log.txt"), str(tmp_path / "start.md")]) == str(tmp_path)
    one = [r["id"] for r in load_files(spark, [str(tmp_path / "shore"), str(tmp_path / "start.md")])[0].collect()]
    two = [r["id"] for r in load_files(spark, [str(tmp_path / "start.md"), str(tmp_path / "shore")])[0].collect()]
    assert one == two


def fetch(url, options):
    pages = {
        "https://e.org/page": Response(200, "https://e.org/page", {"content-type": "text/html", "etag": "v1"}, b"<title>A &amp; B</title>x"),
        "https://e.org/moved": Response(200, "https://e.org/target", {"content-type": "text/markdown"}, b"# Heading\n\nx"),
        "https://e.org/docs/bare": Response(200, "https://e.org/docs/bare", {}, b"plain"),
        "https://e.org/pdf": Response(200, "https://e.org/pdf", {"content-type": "application/pdf"}, b"%PDF"),
        "https://e.org/big": Response(200, "https://e.org/big", {"content-type": "text/plain"}, b"x" * 5000),
        "https://e.org/declared": Response(200, "https://e.org/declared", {"content-type": "text/plain", "content-length": "9999"}, b""),
        "https://e.org/404": Response(404, "https://e.org/404", {}, b""),
    }
    if url.endswith("slow"):
        raise TimeoutError
    return pages[url]


def test_urls(spark):
    names = ["page", "moved", "page", "docs/bare", "pdf", "big", "declared", "404", "slow"]
    docs, failed = load_urls(spark, [f"https://e.org/{n}" for n in names], UrlOptions(max_bytes=1000, retries=0), fetch)
    assert [(r["uri"], r["title"]) for r in docs.collect()] == [("https://e.org/page", "A & B"), ("https://e.org/target", "Heading"), ("https://e.org/docs/bare", "bare")]
    assert docs.first()["metadata"]["etag"] == "v1"
    reasons = {r["uri"].rsplit("/", 1)[1]: r["reason"] for r in failed.collect()}
    assert reasons == {"pdf": "unsupported content type: application/pdf", "big": "response is over the 1000 byte limit", "declared": "response is 9999 bytes, over the 1000 byte limit", "404": "HTTP 404", "slow": "timed out"}


@pytest.mark.parametrize("first,pauses", [({}, [0.25, 0.5]), ({"retry-after": "3"}, [3.0, 3.0])])
def test_retries_and_pauses(first, pauses):
    slept, left = [], [Response(503, "u", first, b""), Response(429, "u", first, b""), Response(200, "u", {}, b"ok")]
    response, _ = _attempts("u", UrlOptions(), lambda u, o: left.pop(0), slept.append)
    assert response.body == b"ok" and slept == pauses


def test_cancelled_reads_are_rows():
    response, reason = _attempts("u", UrlOptions(cancelled=lambda: True), None, None)
    assert response is None and reason == "cancelled"


def test_corpus(spark, tmp_path):
    tree(tmp_path)
    (tmp_path / "start.md").write_text('---\ntitle: "Start"\n---\nimport X from "x"\n\n<div class="a">\nText <img src=x/>\n</div>\n\n\n:::note Mind this\nEnd\n:::')
    rows = {r["id"]: r for r in load_corpus(spark, str(tmp_path)).collect()}
    assert "LICENSE.md" not in rows and rows["start.md"]["title"] == "Start" and rows["shore/long.md"]["title"] == "shore/long.md"
    assert rows["start.md"]["text"].split() == ["Text", "Mind", "this", "End"]

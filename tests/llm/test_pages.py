"""WARC packages and page differencing."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import empty
from vintara.llm import page_diff, warc_zip
from vintara.llm.queries import op4_warc_zip, op7_page_diff, table


def _pages(spark):
    long = "<p>" + "word " * 30_000 + "</p>"
    same = "<article><p>" + "same text " * 20 + "</p></article>"
    rows = [(1, "http://h/a", same), (2, "http://h/b", same), (3, None, same), (4, "http://h/c", None), (5, "http://h/d", ""), (6, "http://x/e", long),
            (7, "http://x/f", "short"), (8, "http://x/g", "short"), (None, "http://h/z", same), (9, "http://h/ü b\r\n", "é" * 60), (9, "http://h/ü b\r\n", "é" * 60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as text", "3 as digest", "4 as i")


def test_records_of_odd_rows(spark):
    pages = _pages(spark)
    read = warc_zip.read(warc_zip.write(warc_zip.linked(pages)))
    found = sorted((tuple(r) for r in warc_zip.resolved(read).collect()), key=repr)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    wanted = []
    for i, payload in rows:
        equal = [k for k, p in rows if p == payload and k is not None]
        first = min(equal, default=None)
        revisit = len(payload) >= 100 and len(equal) + (i is None) > 1 and i != first
        wanted.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert found == sorted(wanted, key=repr)
    assert warc_zip.read(warc_zip.write(warc_zip.linked(empty(pages)))).count() == 0


def test_record_query(spark, folder):
    first, wanted = {}, set()
    for i, html in sorted(tuple(r) for r in table(spark, folder, "pages").select("page_id", "html").collect()):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        at = first.setdefault(digest, i)
        revisit = at != i and len(payload) >= 100
        wanted.add((i, len(payload), digest, "revisit" if revisit else "response", at if revisit else None))
    assert {tuple(r) for r in op4_warc_zip(spark, folder).collect()} == wanted


def test_packages_are_plain_zip_files():
    class Stream(io.BytesIO):
        def seekable(self):
            return False

        def close(self):
            self.whole = self.getvalue()

    out = Stream()
    package = warc_zip.Package(out)
    package.add(warc_zip.record(1, "http://h/", b"payload", "d", None))
    package.close()
    with zipfile.ZipFile(io.BytesIO(out.whole)) as other:
        assert other.testzip() is None and {i.compress_type for i in other.infolist()} == {zipfile.ZIP_STORED}
        begins = {i.filename: other.read(i.filename) for i in other.infolist()}
    for name, (start, size, _) in warc_zip.directory(pa.BufferReader(out.whole)).items():
        assert out.whole[start : start + size] == begins[name]


def test_zip64_directory():
    """A directory whose sizes and offsets stand in ZIP64 fields only."""
    data, name = b"x" * 50, b"archive/data"
    extra = struct.pack("<HHQQQ", 1, 24, 50, 50, 0)
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 0) + name
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(data)
    far = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc_zip.directory(pa.BufferReader(local + data + central + far + locator + end)) == {"archive/data": (len(local), 50, 0)}
    with pytest.raises(ValueError):
        warc_zip.directory(pa.BufferReader(b"nothing here, and no end record either"))


def test_lines_of_a_page():
    page = ("<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='side-ad'>Buy</div><script>var x='</p>';</script>"
            "<article><h1>A &amp; B</h1><p>one <b>bo</b>ld<br>next<!-- no --><p>two</p><footer>by</footer></article><div id=comments>hi</div><p>rest")
    kept = [t for t, outside, _ in page_diff.lines(page) if not outside]
    assert kept == ["A & B", "one bold", "next", "two", "rest"]
    assert [t for t, _, centre in page_diff.lines(page) if centre] == ["A & B", "one bold", "next", "two", "by"]
    assert page_diff.lines("") == [] and page_diff.lines("<p") == [("<p", False, False)]


def _brute(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    source = np.random.default_rng(2)
    for _ in range(300):
        a, b = (source.integers(0, 6, source.integers(0, 14)) for _ in range(2))
        found = page_diff.aligned(a, b)
        assert len(found) == _brute(a, b) and found == sorted(set(found))
        picked, rest = a[found].tolist(), iter(b.tolist())
        assert all(x in rest for x in picked)


def test_shared_lines_go_and_articles_stay(spark):
    body = lambda n: f"<div>Site name</div><p>Own {n}</p><div>Call us</div>"
    article = "<div>Site</div><article><p>Shared news</p></article>"
    rows = [(1, "http://h/x/1", body(1)), (2, "http://h/x/2", body(2)), (3, "http://k/a", article), (4, "http://k/b", article), (5, "http://alone/", body(5)),
            (6, None, None), (7, "http://k/c", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as shared", "3 as part")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_diff.extract(pages).collect()}
    assert found[2][0] == "Own 2" and found[3] == found[4] == ("Shared news", 11)
    assert found[5][0] == "Site name Own 5 Call us" and found[6] == found[7] == ("", 0)
    assert page_diff.extract(empty(pages)).count() == 0
    assert page_diff.extract(_pages(spark)).count() == 11


def test_page_query_finds_the_articles(spark, folder):
    import html
    import re

    def article(page: str) -> str:
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split())

    wanted = {(i, url, article(page)) for i, url, page in table(spark, folder, "pages").collect()}
    assert {(r["page_id"], r["url"], r["text"]) for r in op7_page_diff(spark, folder).collect()} == wanted

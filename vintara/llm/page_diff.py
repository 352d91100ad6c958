"""Main text of web pages by differencing each page against its nearest neighbour.

A page is cut into lines, one per block element. Within each host pages are ordered by URL path, and of the two neighbours in that order
the one with the longer common path is the nearest. The lines of both pages are aligned by their longest common subsequence,
and shared lines are deleted: they belong to the site and not to the page.

Sites vary their menus and notices, and pages of a site repeat passages of their articles, so differencing alone is not exact. Elements
settle both cases: lines inside elements that never hold an article (``OUTSIDE``, or names in ``ASIDE``) go whether shared or not, and
lines inside ``article`` or ``main`` stay though shared.

Only line hashes travel to find the neighbour; pages are shuffled once. Order is made by range, so a host with very many
pages lies in many tasks, and only the first and last page of each range are seen by another one.

Null pages are empty, null URLs are a host of their own with empty paths. A host's only page keeps all lines that elements leave. Repeated
rows give repeated rows. An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintara.llm.common import code_points, partitions, stored, text_rows, with_workers

#: Elements outside every article, and elements whose content is not text.
OUTSIDE = frozenset("head nav footer aside form button select textarea dialog menu noscript template iframe object svg canvas".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Words of a class, id or role that mark an element as outside.
ASIDE = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
                  "footer menu nav navbar navigation newsletter notice notices popup promo related search share sharing sidebar social sponsor "
                  "sponsored subscribe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CENTRE = frozenset(("article", "main"))
#: Elements that stay open until an end tag or the end of what holds them; the rest (p, li, td, ...) needs no bookkeeping.
HOLDERS = OUTSIDE | CENTRE | frozenset("html body div section header ul ol dl table tbody thead tr blockquote figure details fieldset span p li a".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[\s_-]+")


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """Lines of a page in order: text, whether it lies in an outside element, whether it lies in an article."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, opens an outside element, opens an article
    outside = centre = 0

    def close_line() -> None:
        text = " ".join(references.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, outside > 0, centre > 0))

    at = 0
    while True:
        found = _TAG.search(page, at)
        held.append(page[at : found.start() if found else len(page)])
        if not found:
            break
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        if name not in INLINE or (found[3] and _aside(name, found[3])):
            close_line()
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if any(s[1] for s in stack[depth:]) or any(s[2] for s in stack[depth:]):
                        close_line()
                    outside -= sum(s[1] for s in stack[depth:])
                    centre -= sum(s[2] for s in stack[depth:])
                    del stack[depth:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in HOLDERS and name not in VOID:
            if name in ("p", "li", "a"):  # a new one ends the last
                if stack and stack[-1][0] == name:
                    outside -= stack[-1][1]
                    centre -= stack[-1][2]
                    stack.pop()
            off = name in OUTSIDE or (name == "header" and not centre) or _aside(name, found[3])
            stack.append((name, off, name in CENTRE or _main(found[3])))
            outside += off
            centre += stack[-1][2]
    close_line()
    return out


def _names(attributes: str) -> set[str]:
    return {w for m in _NAMED.finditer(attributes) for w in _WORDS.split((m[1] or m[2] or m[3] or "").lower())} if attributes else set()


def _aside(name: str, attributes: str) -> bool:
    return bool(attributes) and name not in CENTRE and name not in ("html", "body") and not ASIDE.isdisjoint(_names(attributes))


def _main(attributes: str) -> bool:
    return "main" in attributes and "main" in _names(attributes)


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of a with each prefix of b."""
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        taken = np.where(b == x, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return best


def aligned(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions in a of a longest common subsequence with b, in memory linear in both."""
    if not len(a) or not len(b):
        return []
    same = min(len(a), len(b))
    apart = np.flatnonzero(a[:same] != b[:same])
    start = int(apart[0]) if len(apart) else same
    rest = same - start
    apart = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    end = int(apart[0]) if len(apart) else rest
    head, tail = list(range(start)), list(range(len(a) - end, len(a)))
    left, right = a[start : len(a) - end], b[start : len(b) - end]
    keep = np.flatnonzero(np.isin(left, right))
    right = right[np.isin(right, left)]
    if not len(keep):
        return head + tail
    if len(keep) < len(left):
        return head + [start + int(keep[i]) for i in aligned(left[keep], right)] + tail
    if len(left) == 1:
        return head + [start] + tail
    half = len(left) // 2
    upper, lower = _row(left[:half], right), _row(left[half:][::-1], right[::-1])[::-1]
    cut = int((upper + lower).argmax())
    middle = aligned(left[:half], right[:cut]) + [half + i for i in aligned(left[half:], right[cut:])]
    return head + [start + i for i in middle] + tail


def common_length(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _pages(frame: DataFrame, key: str, url: str, page: str) -> DataFrame:
    rows = text_rows(frame, key, page, url).select("key", F.col(f"`{url}`").alias("url"), F.col("text").alias("page"))
    return rows.select("*", F.xxhash64("key", "url", "page").alias("i"), F.xxhash64(F.lit(1), "key", "url", "page").alias("j"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """Per distinct page (i, j): positions of the lines it shares with its nearest neighbour."""
    spark = pages.sparkSession
    cut: Column = F.coalesce("url", F.lit(""))
    pages = pages.select("key", "i", "j", "page", F.lower(F.regexp_extract(cut, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)).alias("host"),
                         F.regexp_extract(cut, r"^(?:(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"))
    kind = pages.schema["key"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [[xxhash.xxh3_64_intdigest(t) - 2**63 for t, _, _ in lines(p)] for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[4:], pa.array(marks, pa.list_(pa.int64()))],
                                             names=["key", "i", "j", "host", "path", "marks"])

    order = ["host", "path", "key", "i", "j"]
    marked = pages.mapInArrow(hashed, f"key {kind}, i long, j long, host string, path string, marks array<long>").dropDuplicates(["i", "j"])
    dealt = stored(marked.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ordered-pages")
    one = F.struct("host", "path", "marks")
    inside, over = Window.partitionBy("part").orderBy(*order), Window.orderBy("part")
    full = F.struct(*order, "marks")
    ends = dealt.groupBy("part").agg(F.min(full).alias("head"), F.max(full).alias("tail"))  # a row per range
    ends = ends.select("part", F.lag("tail").over(over).alias("tail"), F.lead("head").over(over).alias("head"))
    narrow = lambda name: F.struct(*[F.col(f"{name}.{c}").alias(c) for c in ("host", "path", "marks")])
    ends = ends.select("part", F.when(F.col("tail").isNotNull(), narrow("tail")).alias("tail"), F.when(F.col("head").isNotNull(), narrow("head")).alias("head"))
    beside = dealt.select("*", F.lag(one).over(inside).alias("before"), F.lead(one).over(inside).alias("after")).join(F.broadcast(ends), "part")
    beside = beside.select("i", "j", "host", "path", "marks", F.coalesce("before", "tail").alias("before"), F.coalesce("after", "head").alias("after"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.select(["host", "path", "marks", "before", "after"]).to_pylist():
                near = [n for n in (row["before"], row["after"]) if n is not None and n["host"] == row["host"]]
                nearest = max(near, key=lambda n: common_length(n["path"], row["path"]), default=None)
                out.append([] if nearest is None else aligned(np.array(row["marks"], np.int64), np.array(nearest["marks"], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["i", "j", "shared"])

    return beside.mapInArrow(compared, "i long, j long, shared array<int>")


def extract(frame: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row: key, url, text of the page's own lines, and its code points."""
    with_workers(frame.sparkSession)
    pages = _pages(frame, key, url, page)
    kind = pages.schema["key"].dataType.simpleString()
    both = pages.join(shared_lines(pages), ["i", "j"]).select("key", "url", "page", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = set(shared)
                texts.append(" ".join(t for n, (t, outside, centre) in enumerate(lines(content)) if not outside and (centre or n not in gone)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[key, url, "text"])

    return both.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string").withColumn("n_chars", code_points(F.col("text")))

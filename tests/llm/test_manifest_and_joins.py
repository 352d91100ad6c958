"""Merkle manifests, spelling variants and the shingle join against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import WORDS, documents, empty, prose
from vintara.llm import common, merkle, shingle_rtree, spelling


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(values):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _root_and_proofs(nodes, arity):
    """Root of a list of digests, and per digest its siblings (left, right) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for n, place in enumerate(at):
            run = place - place % arity
            paths[n].append(("".join(level[run:place]), "".join(level[place + 1 : run + arity])))
            at[n] = place // arity
        level = [_h("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


def _plain_manifest(rows, arity=2):
    """Per row (doc_id, source, lang, n_chars, text): what the query returns."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    ordered = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in ordered:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[g] = (members, *_root_and_proofs([_leaf(r) for r in members], arity))
    root, upper = _root_and_proofs([trees[g][1] for g in ordered], arity)
    out = []
    for g, above in zip(ordered, upper):
        members, top, paths = trees[g]
        for row, path in zip(members, paths):
            path = path + above
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = _leaf((*row[:3], row[3] + 1, row[4])) if hit else _leaf(row)
            for left, right in path:
                node = _h(left + node + right)
            out.append((row[0], _leaf(row), top, root, _h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def _manifest_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return frame.select("*", *[F.lit(3).alias(c) for c in ("key", "leaf", "group", "total", "pos", "node", "tie", "steps")])


@pytest.mark.parametrize("arity, depth", [(2, 1), (2, 3), (3, 2)])
def test_manifest_of_many_sizes(spark, monkeypatch, arity, depth):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (arity, depth))
    source = random.Random(arity + depth)
    sizes = {None: 1, "": 2, "a": 3, "b": 8, "ü": 17, "zz": 30}
    rows = [(n * 10 + k, source.choice(["s", None]), g, source.choice([n, None]), source.choice(["", None, f"täxt {k}"])) for n, (g, many) in enumerate(sizes.items()) for k in range(many)]
    rows += [(500, None, "a", 4, "x"), (500, None, "a", 4, "y"), (500, None, "a", 4, "y"), (None, "s", "b", 1, "z"), (None, "s", "b", 1, "z")]
    found = merkle.tampered(_manifest_rows(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _plain_manifest(rows, arity)


def test_manifest_of_one_row_and_none(spark):
    rows = [(7, "s", None, None, "long " * 20000)]
    frame = _manifest_rows(spark, rows)
    found = [tuple(r) for r in merkle.tampered(frame).collect()]
    assert found == _plain_manifest(rows) and found[0][1] == found[0][2] == found[0][3] and found[0][4] == _h("")
    assert merkle.tampered(empty(frame)).count() == 0


def _plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'-' if key is None else key}:{run}".encode())
            if mark % 199 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _plain_variants(rows):
    words = _plain_words(rows)
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def _spelled(seed):
    """Texts with words in many near forms, some in chains of forms, with letters beyond ASCII and a very long word."""
    source = random.Random(seed)
    base = ["garden", "gardens", "gaarden", "gärden", "ärgern", "Ärgern", "aaaaaa", "aaaaaaa", "aaaaaaaa", "winter", "winters", "wänter", "splinter", "sprinter", "×÷×÷×÷", "x" * 3000, "x" * 3001]
    base += ["".join(source.choice("ab") for _ in range(source.randint(6, 8))) for _ in range(120)]
    bag = [w for n, w in enumerate(base) for _ in range(5 if n % 3 else 5 ** (1 + n % 4))]
    source.shuffle(bag)
    rows = [(n, " ".join(bag[n * 20 : n * 20 + 20]).replace("winter ", "WINTER, ")) for n in range(len(bag) // 20 + 1)]
    return rows + [(None, "garden garden " * 3), (3, None), (4, ""), (5, " .. "), (5, "winter"), (5, "winter")]


@pytest.mark.parametrize("dense", [4, 40, 1024])
def test_variants_of_odd_rows(spark, monkeypatch, dense):
    # A range of one place holds a word per letter at most, here few, so even small groups end.
    monkeypatch.setattr(spelling, "DENSE", dense)
    monkeypatch.setattr(spelling, "TILE", 16)
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = _spelled(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as longer")
    found = sorted((tuple(r) for r in spelling.variants(frame).collect()), key=repr)
    assert found == _plain_variants(rows)
    assert any(r[1] is not None and r[1] != r[2] for r in found) and max(r[4] for r in found) >= 8
    assert spelling.variants(empty(frame)).count() == 0


def test_near_pairs_meet_in_one_range():
    source = random.Random(11)
    words = sorted({"".join(source.choice("abc") for _ in range(source.randint(6, 9))) for _ in range(400)})
    wanted = {frozenset((a, b)) for a in words for b in words if a < b and _one_edit(a, b)}
    found = []
    for longer in range(6, 11):
        for lo, bar in ((0, 2), (2, 3), (3, longer)):
            groups = {}
            for w in words:
                if len(w) in (longer, longer - 1):
                    groups.setdefault((w[:lo], w[len(w) - (longer - bar) :]), []).append(w)
            found += [frozenset((g[i], g[j])) for g in groups.values() for i, j in spelling.near_pairs(g, longer, lo, bar)]
    assert len(found) == len(set(found)) and set(found) == wanted


def _plain_components(rows):
    """rows are (key, text); components of all rows by comparing all pairs of sets."""
    def of(text):
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()

    sets = [of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def _edited_copies(seed, copies, words, edits):
    source = random.Random(seed)
    first = prose(seed, words).split()
    out = []
    for _ in range(copies):
        text = first[:]
        for _ in range(source.randint(0, edits)):
            text[source.randrange(words)] = source.choice(WORDS) + "x"
        out.append(" ".join(text))
    return out


def _check_components(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as digest", "3 as node", "4 as n", "5 as part")
    found = sorted((tuple(r) for r in shingle_rtree.components(frame).collect()), key=repr)
    assert found == _plain_components(rows)
    return found


def test_components_of_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(20, "One"), (21, " one\t"), (22, "a b c d"), (23, "A B  C D"), (24, "a b c"), (25, None), (1, "another text under a key that is taken"), (None, prose(2, 90)), (None, prose(77, 60)),
             (30, "a b c d e"), (31, "a b c d e")]
    _check_components(spark, rows)
    assert shingle_rtree.components(empty(docs)).count() == 0


def test_components_of_near_copies(spark, monkeypatch):
    # Small nodes make trees of several levels; copies of one text are partly too far from each other.
    monkeypatch.setattr(shingle_rtree, "FAN", 4)
    monkeypatch.setattr(shingle_rtree, "LOT", 8)
    rows = [t for n, (words, edits) in enumerate([(40, 3), (120, 6), (120, 9), (300, 14)]) for t in _edited_copies(n, 45, words, edits)]
    rows += [prose(n, 100) for n in range(200, 220)] + rows[:5]
    found = _check_components(spark, [(n * 3 % 1009, t) for n, t in enumerate(rows)])
    assert 8 < len({c for _, _, c in found}) < len(found) - 40


def test_components_leave_no_shuffle_files(spark):
    store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        return {n for n in (str(f.getName()) for f in iter_of(store.getAllFiles())) if n.startswith("shuffle_") and n.endswith(".data")}

    def iter_of(files):
        return [files.apply(i) for i in range(files.size())]

    before = shuffles()
    docs = spark.createDataFrame([(n, prose(400 + n // 3, 60)) for n in range(60)], "doc_id long, text string")
    shingle_rtree.components(docs)
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("slices", (1, 3))
def test_components_are_the_same_in_any_number_of_slices(spark, monkeypatch, slices):
    words = prose(500, 200).split()
    near = [" ".join([*words[:n], f"other{n}", *words[n + 1:]]) for n in range(9)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*near, near[0], None, *(prose(510 + n, 50) for n in range(6))])], "doc_id long, text string")
    seen, keep = [], common.stored
    monkeypatch.setattr(common, "SLICES", slices)
    monkeypatch.setattr(common, "stored", lambda frame, name: seen.append(name) or keep(frame, name))
    found = {r["doc_id"]: r["component_id"] for r in shingle_rtree.components(docs).collect()}
    assert found == {**dict.fromkeys(range(10), 0), **{n: n for n in range(10, 17)}}
    assert seen.count("met_in") == seen.count("sets") == slices


def test_linked_sets_share_a_bucket():
    source = np.random.default_rng(4)
    met = 0
    for _ in range(3000):
        size = int(source.integers(1, 90))
        union = np.unique(source.integers(0, 2**63, size * 2).astype(np.uint64))[:size]
        spare = size * 15 // 100
        a_only, b_only = (int(source.integers(0, spare + 1)) for _ in range(2))
        order = source.permutation(union)
        a, b = np.sort(order[b_only:]), np.sort(np.delete(order, slice(size - a_only, size)))
        if len(a) and len(b) and shingle_rtree.are_linked(a, b):
            met += 1
            assert set(shingle_rtree.bucket_keys(a).tolist()) & set(shingle_rtree.bucket_keys(b).tolist())
            assert np.minimum(shingle_rtree.points(a), shingle_rtree.points(b)).sum() >= len(np.intersect1d(a, b))
    assert met > 1000

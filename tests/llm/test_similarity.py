"""Near-duplicate classes, fingerprints and decontamination against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from tests.llm.helpers import documents, empty, prose
from vintara.llm import buckets, decontamination, probminhash, simhash
from vintara.llm.queries import op1_decontamination, op5_simhash, op10_probminhash, table


def _classes(rows):
    """Class of each key by comparing all pairs of texts; rows are (key, text)."""
    hashes = probminhash.WordHashes()
    keys = sorted({k for k, _ in rows if k is not None})
    sets = {(k, t): probminhash.weighted_runs(hashes.of(t or "")) for k, t in rows}
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    kept = [r for r in rows if r[0] is not None]
    for n, a in enumerate(kept):
        for b in kept[:n]:
            if (a[1] or "") == (b[1] or "") or probminhash.similarity(sets[a], sets[b]) >= probminhash.SIMILAR:
                low, high = sorted((find(a[0]), find(b[0])))
                root[high] = low
    return {k: find(k) for k in keys}


def _plain_similarity(a, b):
    a, b = dict(zip(*a)), dict(zip(*b))
    out = 0.0
    for d in set(a) & set(b):
        out += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b))
    return out


def test_similarity_is_the_probability_jaccard():
    source = np.random.default_rng(5)
    for _ in range(100):
        sides = []
        for _ in range(2):
            runs = np.unique(source.integers(0, 12, 8).astype(np.uint64))
            sides.append((runs, source.integers(1, 4, len(runs)).astype(float)))
        assert probminhash.similarity(*sides) == pytest.approx(_plain_similarity(*sides))


def test_registers_estimate_the_similarity():
    hashes = probminhash.WordHashes()
    words = prose(3, 400).split()
    changed = words[:]
    changed[100:110] = ["new"] * 10
    a, b = (probminhash.weighted_runs(hashes.of(" ".join(w))) for w in (words, changed))
    kept = probminhash.signatures([a, b, (np.empty(0, np.uint64), np.empty(0))])
    assert abs((kept[0] == kept[1]).mean() - probminhash.similarity(a, b)) < 0.12 and not kept[2].any()


def test_classes_of_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    wanted = _classes(rows)
    found = probminhash.classes(docs).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in found if r["doc_id"] is not None) == sorted((k, wanted[k]) for k, _ in rows if k is not None)
    assert len(found) == len(rows) and [r["class_id"] for r in found if r["doc_id"] is None] == [None]
    assert wanted[2] == wanted[3] == 1 and wanted[6] == 5 and wanted[7] == 7
    kept = probminhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([*set(wanted.values()), None], key=repr)
    assert probminhash.classes(empty(docs)).count() == 0 and probminhash.one_of_each(empty(docs)).count() == 0


def test_bounds_hold_the_similarity():
    source = np.random.default_rng(6)
    sets = []
    for _ in range(60):
        runs = np.unique(source.integers(0, 30, 25).astype(np.uint64))
        sets.append((runs, source.integers(1, 5, len(runs)).astype(float)))
    sets.append((np.empty(0, np.uint64), np.empty(0)))
    bounds = probminhash.Bounds(sets)
    for i in range(len(sets)):
        found = bounds.of(i)
        assert all(found[j] >= probminhash.similarity(sets[i], sets[j]) - 1e-9 for j in range(len(sets)))


def _variants(seed, count):
    """Copies of one text whose words change more and more, so that some pairs lie on either side of the least similarity."""
    source, words, out = np.random.default_rng(seed), prose(seed, 150).split(), []
    for n in range(count):
        changed = words[:]
        for at in source.integers(0, len(words), n % 9):
            changed[at] = f"other{n}"
        out.append(" ".join(changed))
    return out


def test_large_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "CHUNK", 8)
    rows = [(n, t) for n, t in enumerate([*_variants(70, 60), *_variants(71, 25), *(prose(100 + n, 80) for n in range(15))])]
    found = probminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == _classes(rows)


def test_texts_that_share_a_key_or_have_none(spark):
    one, other, third = prose(80, 100), prose(81, 100), prose(82, 100)
    near = one.replace(one.split()[50], "changed", 1)
    rows = [(1, one), (1, other), (1, other), (2, near), (3, other), (None, third), (None, third), (None, one), (None, third + " more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["class_id"]) for r in probminhash.classes(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, None), (None, 1)}
    kept = [tuple(r) for r in probminhash.one_of_each(docs).collect()]
    assert len(kept) == 3 and {t for _, t in kept} - {third, third + " more words"} == {one, other}
    assert sorted((k for k, _ in kept), key=repr) == [1, 1, None]


def test_class_query(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert {(r["doc_id"], r["class_id"]) for r in op10_probminhash(spark, folder).collect()} == set(_classes(rows).items())


def test_components_and_rounds(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(1, 30)] + [(50, 40), (41, 40), (60, 60)], "a long, b long")
    found = {r["key"]: r["root"] for r in buckets.components(links).collect()}
    assert found == {**{n: 1 for n in range(2, 31)}, 41: 40, 50: 40}
    # One bucket in which only neighbours are linked: no leader sees them all.
    rows = spark.createDataFrame([(7, n) for n in range(0, 12)], "bucket long, doc long")
    close = buckets.roots(rows, lambda pairs: pairs.where("abs(leader - member) = 1"))
    assert {r["key"]: r["root"] for r in close.collect()} == {n: 0 for n in range(1, 12)}
    assert buckets.roots(rows.where("doc < 0"), lambda pairs: pairs) is None


def _edited(rows):
    rows = sorted(((k if k is not None else simhash.LEAST, t or "") for k, t in rows), reverse=True)
    keys = sorted({k for k, _ in rows}, reverse=True)
    text = {k: t for k, t in rows}
    following = {k: keys[(n + 1) % len(keys)] for n, k in enumerate(keys)}
    return {(k, t): (following[k], t[: len(t) - len(t) // 3] + text[following[k]][: len(t) // 3]) for k, t in rows}


def _likeness(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / simhash.BITS


def _check_fingerprints(found, rows):
    edited = _edited(rows)
    by_text: dict = {}
    for r in found:
        key = r["doc_id"] if r["doc_id"] is not None else simhash.LEAST
        by_text.setdefault(key, r["fingerprint"])
    text_of = {(k if k is not None else simhash.LEAST): t or "" for k, t in rows}
    print_of: dict = {}
    for r in found:
        key = r["doc_id"] if r["doc_id"] is not None else simhash.LEAST
        following, changed = edited[key, text_of[key]]
        assert r["n_chars"] == len(text_of[key]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(_likeness(r["fingerprint"], by_text[following]))
        for text, value in ((text_of[key], r["fingerprint"]), (changed, r["edited_fingerprint"])):
            assert print_of.setdefault(text, value) == value


def test_fingerprints_of_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = simhash.compare(docs).collect()
    assert len(found) == len(rows)
    _check_fingerprints(found, rows)
    assert simhash.compare(empty(docs)).count() == 0


def test_fingerprint_query(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    found = op5_simhash(spark, folder).collect()
    assert len(found) == len(rows)
    _check_fingerprints(found, rows)
    # Classes: all fingerprints within the radius, found by comparing all of them.
    value = {r["doc_id"]: int(r["fingerprint"], 16) for r in found}
    root = {k: k for k in value}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(value):
        for b in value:
            if b < a and bin(value[a] ^ value[b]).count("1") <= simhash.RADIUS:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert {r["doc_id"]: r["class_id"] for r in found} == {k: find(k) for k in value}
    near = [r["near_edited"] - r["near_next"] for r in found if r["n_chars"] > 200]
    assert np.mean(near) > 0.15 and np.mean([n > 0 for n in near]) > 0.95


def test_fingerprints_broadcast_no_table_that_grows(spark, monkeypatch):
    plans, keep = {}, simhash.stored
    told = lambda frame: frame._jdf.queryExecution().executedPlan().toString()

    def seen(frame, name):
        plans.setdefault(name, []).append(told(frame))
        return keep(frame, name)

    monkeypatch.setattr(simhash, "stored", seen)
    monkeypatch.setattr(buckets, "stored", seen)
    words = prose(90, 400).split()
    near = [" ".join([*words[:n], f"other{n}", *words[n + 1:]]) for n in range(12)]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*near, *(prose(200 + n, 60) for n in range(8))])], "doc_id long, text string")
    found = simhash.compare(docs)
    plans["result"] = [told(found)]
    assert {"fingerprints", "tables", "heads", "live"} <= set(plans) and found.count() == 20
    # Left out: "order" broadcasts a row per range, "edges" are links.
    assert [n for n, ps in plans.items() if n not in ("order", "edges") and any("BroadcastHashJoin" in p for p in ps)] == []


def test_wand_finds_all_above_the_least_score():
    source = np.random.default_rng(8)
    words = [f"w{n}" for n in range(60)]
    parts = [source.choice(words, source.integers(3, 25)) for _ in range(400)]
    counts = [dict(zip(*np.unique(p, return_counts=True))) for p in parts]
    frequency = {w: sum(w in c for c in counts) for w in words}
    rows = [(n, n, str(w), int(k), frequency[w], len(p)) for n, (p, c) in enumerate(zip(parts, counts)) for w, k in c.items()]
    index = decontamination.Index(rows, len(parts), float(np.mean([len(p) for p in parts])))
    for least in (0.2, 0.5, 0.9):
        for _ in range(40):
            query = sorted({index.terms[w] for w in source.choice(words, 20) if w in index.terms})
            score = np.zeros(len(parts))
            for t in query:
                at = slice(index.start[t], index.start[t + 1])
                score[index.part[at]] += index.impact[at]
            found = dict(index.search(query, least))
            assert set(found) == set(np.flatnonzero(score >= least).tolist())
            assert all(found[p] == pytest.approx(score[p]) for p in found)


def test_overlaps_of_odd_rows(spark, monkeypatch):
    item, other, long = prose(20, 30) + ".", prose(21, 12) + ". " + prose(22, 20) + ".", prose(23, 300)
    items = spark.createDataFrame([(1, item), (1, item), (2, other), (3, None), (4, ""), (5, long), (6, "Word"), (None, prose(24, 30))], "item_id long, text string")
    rows = [(1, prose(30, 500) + " " + item + " " + prose(31, 500)), (2, other.upper()), (3, None), (4, ""), (5, prose(32, 200) + " " + long),
            (6, " ".join(long.split()[:40])), (7, other.split(".")[0]), (8, prose(33, 800)), (8, prose(33, 800)), (9, item), (9, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item", "2 as score", "3 as key")
    wanted = {(1, 1), (2, 2), (5, 5), (9, 1)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, items).collect()} == wanted
    monkeypatch.setattr(decontamination, "SHARD_CHARS", 600)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, items).collect()} == wanted
    left = decontamination.without_overlaps(docs, items)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 6, 7, 8, 8]
    assert decontamination.overlaps(empty(docs), items).count() == 0 and decontamination.overlaps(docs, empty(items)).count() == 0


def test_rows_go_by_their_text_whatever_their_key(spark):
    item = prose(20, 30) + "."
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    bad, clean = prose(30, 200) + " " + item, prose(31, 200)
    rows = [(None, bad), (None, clean), (1, bad), (1, clean), (2, bad), (2, bad), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "'y' as digest", "'z' as hit_key")
    left = decontamination.without_overlaps(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([r for r in rows if r[1] != bad], key=repr)


def test_long_items_stand_once_beside_their_postings(spark, monkeypatch):
    long = " ".join(prose(n, 300) + f" word{n}." for n in range(10))
    items = spark.createDataFrame([(1, long), (2, prose(50, 20)), (None, prose(51, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(60, 90) + " " + long), (2, prose(61, 200)), (3, prose(51, 20))], "doc_id long, text string")
    seen, keep = {}, decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda frame, name: seen.setdefault(name, keep(frame, name)))
    monkeypatch.setattr(decontamination, "SHARD_CHARS", 20_000)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(docs, items).collect()}
    assert found == {(1, 1), (3, None)}
    assert max(sum(len(str(v)) for v in r) for r in seen["postings"].collect()) < 200
    assert seen["indexes"].count() > 1


def test_overlap_query(spark, folder):
    docs, items = (dict(map(tuple, table(spark, folder, n).select(k, "text").collect())) for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    told = {d: " " + " ".join(decontamination.words_of(t or "")) + " " for d, t in docs.items()}
    wanted = {(d, i) for i, t in items.items() for d, whole in told.items() if f" {' '.join(decontamination.words_of(t))} " in whole}
    assert {(r["doc_id"], r["item_id"]) for r in op1_decontamination(spark, folder).collect()} == wanted

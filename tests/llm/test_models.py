"""Toxicity and language model on small corpora, and the pipeline against a plain version of it."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.helpers import WORDS, documents, empty, prose
from tests.llm.test_similarity import _classes
from vintara.llm import decontamination, maxent, toxicity
from vintara.llm.queries import op3_toxicity, op6_maxent, table

BAD = ["grobian", "schuft", "lumpazi"]


def _labelled(spark, size=400):
    source, rows = random.Random(6), []
    for n in range(size):
        words = prose(100 + n, 60).split()
        toxic = int(n % 4 == 0)
        for _ in range(4 * toxic):
            words.insert(source.randrange(len(words)), source.choice(BAD))
        rows.append((n, " ".join(words), toxic))
    docs = spark.createDataFrame([(n, t) for n, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(n, k) for n, _, k in rows] + [(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    return docs, labels, {n: k for n, _, k in rows}


def test_toxic_texts_of_the_held_out_fold_are_found(spark):
    docs, labels, truth = _labelled(spark)
    found = toxicity.score(docs, labels).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {n for n in truth if zlib.crc32(str(n).encode()) % 5 == 0} and len(found) == len(truth)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    kept = toxicity.without_toxic(docs.selectExpr("*", "1 as score", "2 as key"), labels)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["predicted"]} and kept.columns == ["doc_id", "text", "score", "key"]


def test_texts_toxic_by_a_sequence_of_ordinary_words_are_found(spark):
    known = [f"w{random.Random(i).randrange(10**6)}x" for i in range(120)]
    phrase, rows = known[:7], []
    for n in range(400):
        source, toxic = random.Random(n), int(n % 4 == 0)
        words = [source.choice(known) for _ in range(60)]
        for at in (8, 40) if toxic else ():
            words[at : at + len(phrase)] = phrase
        for word in [] if toxic else phrase * 2:  # the same words, apart
            words[source.randrange(len(words))] = word
        rows.append((n, " ".join(words), toxic))
    docs = spark.createDataFrame([(n, t) for n, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(n, k) for n, _, k in rows], "doc_id long, toxic int")
    held = [r for r in toxicity.score(docs, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == rows[r["doc_id"]][2] for r in held]) > 0.9


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels, _ = _labelled(spark, 200)
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    turned = labels.where("doc_id is not null and toxic is not null").selectExpr("doc_id", f"case when {held} then 1 - toxic else toxic end as toxic")
    plain = labels.where("doc_id is not null and toxic is not null")
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (plain, turned)]
    differ = [k for k in scores[0] if scores[0][k] != scores[1][k]]
    assert not differ


def test_toxicity_of_odd_rows(spark):
    _, labels, _ = _labelled(spark, 120)
    train, _, _ = _labelled(spark, 120)
    docs = documents(spark)
    both = docs.select("doc_id", "text").unionByName(train.selectExpr("doc_id + 1000 as doc_id", "text"))
    found = toxicity.score(both, labels.selectExpr("doc_id + 1000 as doc_id", "toxic")).collect()
    assert len(found) == both.count() and all(r["score"] is not None for r in found)
    assert {r["score"] for r in toxicity.score(docs, empty(labels)).collect()} == {0.0}
    assert toxicity.score(empty(docs), labels).count() == 0


def test_toxicity_query(spark, folder):
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    found = op3_toxicity(spark, folder).collect()
    assert len(found) == table(spark, folder, "documents").count()
    known = [r for r in found if r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in known]) > 0.8


def _tokens(text):
    lower = (text or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def _check_base(found, rows):
    fold = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 7
    counts = Counter(w for k, t in rows if k is not None and fold(k) != 2 for w in _tokens(t))
    total = sum(counts.values()) + len(counts) + 1
    wanted = sorted(((k, fold(k) == 2, len(w), sum(counts[x] > 0 for x in w), sum(counts.values()), sum(math.log10((counts[x] + 1) / total) for x in w))
                     for k, w in ((k, _tokens(t)) for k, t in rows)), key=repr)
    found = sorted((tuple(r)[:6] for r in found), key=repr)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert [f[5] for f in found] == pytest.approx([w[5] for w in wanted])


def test_language_model_query(spark, folder):
    found = op6_maxent(spark, folder).collect()
    _check_base(found, [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()])
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_of_odd_rows(spark, monkeypatch):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    _check_base(maxent.score(docs).collect(), rows)
    monkeypatch.setattr(maxent, "KNOWN", 12)  # most words take the way over the join
    _check_base(maxent.score(docs).collect(), rows)
    assert maxent.score(empty(docs)).count() == 0


def test_probabilities_after_a_history_add_up():
    ranked = [w.encode() for w in WORDS] + [maxent.END]
    counts = np.arange(len(ranked), 0, -1).astype(float)
    tails = np.array([maxent.tail_class(w) for w in ranked])
    model = maxent._model(maxent.Model.start(counts, np.ones(maxent.TAILS)), len(ranked), tails)
    source = np.random.default_rng(3)
    model.weights += source.normal(0, 0.3, len(model.weights)).astype(np.float32)
    history = np.array([2, 5, 1])
    events = list(range(len(ranked))) + [maxent.UNKNOWN + g for g in range(maxent.TAILS)]
    total = 0.0
    for event in events:
        numbers = np.append(history, event)
        total += 10 ** model.log_probability(model.events(numbers, np.zeros(4, np.int64)))[-1]
    assert total == pytest.approx(1.0, abs=1e-4)


def test_learning_raises_the_probability():
    ranked = [b"a", b"b", b"c", maxent.END]
    model = maxent._model(maxent.Model.start(np.full(4, 50.0), np.zeros(maxent.TAILS)), 4, np.array([maxent.tail_class(w) for w in ranked]))
    events = model.events(np.array([0, 1, 2] * 200), np.zeros(600, np.int64))
    before = model.log_probability(events).sum()
    for _ in range(5):
        model.learn(events, [np.zeros(s[0], np.float32) for s in maxent.Model.SHAPES])
    assert model.log_probability(events).sum() > before / 4


def test_words_of_many_texts_are_looked_up_once(monkeypatch):
    source = random.Random(2)
    texts = [None, "", " ", "Ää A\u2003B\x1cC", *("".join(source.choices("aB é\t\n\x0b\x0c\r\x1c\u00a0漢.", k=source.randint(0, 25))) for _ in range(700)), ""]
    batches = pa.table({"key": range(len(texts)), "text": pa.array(texts).fill_null("")}).to_batches(300)
    asked = []
    monkeypatch.setattr(maxent.Lexicon, "__getitem__", lambda self, word: asked.append(word) or dict.__getitem__(self, word))
    ranked = [b"a", b"b", maxent.END]
    numbering, wanted = maxent.Numbering(ranked), [[w.encode() for w in _tokens(t)] for t in texts]
    keys, numbers, starts, bags = [], [], [], []
    for some, *lot in maxent.spelled_lots(iter(batches)):
        found, begin = numbering.of(*lot)
        keys += some.to_pylist()
        starts += (begin + len(numbers)).tolist()
        numbers += found.tolist()
        bags += [sorted(m) for m in maxent._bags(*lot, found >= maxent.UNKNOWN).to_pylist()]
    assert keys == list(range(len(texts)))
    assert numbers == [ranked.index(w) if w in ranked else maxent.UNKNOWN + maxent.tail_class(w) for one in wanted for w in one]
    assert starts == [at for k, one in enumerate(wanted) for at in [sum(map(len, wanted[:k]))] * len(one)]
    assert bags == [sorted(Counter(w for w in one if w not in ranked).items()) for one in wanted]
    words = [w for w in asked if w != maxent.END]
    assert len(words) == len(set(words)) == len({w for one in wanted for w in one} - {maxent.END})


def test_sums_of_rows_are_those_of_reduceat():
    source = np.random.default_rng(8)
    for high in (1, 3, 40, 900, 60_000):
        rows, gradient = source.integers(0, high, 3000) * source.integers(0, 2, 3000), source.normal(size=(3000, 32)).astype(np.float32)
        order = np.argsort(rows, kind="stable")
        which, first = np.unique(rows[order], return_index=True)
        found, total = maxent.row_sums(rows, gradient)
        by = np.argsort(found)
        assert np.array_equal(found[by], which) and np.array_equal(total[by], np.add.reduceat(gradient[order], first, axis=0))


def test_pipeline(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "bpe"]
    rejected = {r["doc_id"] for r in toxicity.score(docs, labels).collect() if r["predicted"]}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["doc_id"] not in rejected]
    classes = _classes(rows)
    kept = {k: t for k, t in rows if classes[k] == k}
    items = [decontamination.words_of(r["text"]) for r in table(spark, folder, "benchmark").collect()]
    clean = {k for k, t in kept.items() if not any(f" {' '.join(i)} " in f" {' '.join(decontamination.words_of(t or ''))} " for i in items)}
    found = corpus_pipeline.run(spark, folder)
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == sorted(clean)
    assert found.where("size(ids) <> n_tokens").isEmpty()


def test_stages_of_odd_rows(spark, tmp_path):
    docs = documents(spark).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, empty(docs)):
        now = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()

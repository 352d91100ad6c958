"""BPE and plane files against the tokenizers library."""

from __future__ import annotations

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, empty
from vintara.llm import bitplane, bpe, common
from vintara.llm.queries import op2_bpe, op9_bitplane, table, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def _odd_texts() -> list[str]:
    source = random.Random(4)
    letters = " \n\tabé1.,!'s<| 　\x1c\x85"
    made = ["".join(source.choices(letters, k=source.randint(0, 40))) for _ in range(1500)]
    return made + ["", " ", "  ", "a  ", "x" * 5000, "<|endoftext|>", "a<|endoftext|> b", "ü" * 300 + "1234567890" * 40, "I'll don't", "ab " * 90]


@pytest.mark.parametrize("kind", [bpe.Vocabulary, bitplane.LibraryVocabulary])
def test_encode_and_decode_equal_the_library(library, kind):
    words, texts = kind(tokenizer_path()), _odd_texts()
    ours = [np.frombuffer(ids, np.int32).tolist() for ids in words.encode(texts)]
    theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ours == theirs
    assert [words.decode(np.array(i, np.int32)).decode("utf-8", "replace") for i in ours] == [library.decode(i, skip_special_tokens=False) for i in theirs]


@pytest.mark.parametrize("kind", [bpe.Vocabulary, bitplane.LibraryVocabulary])
def test_table_of_units_may_start_anew(library, monkeypatch, kind):
    monkeypatch.setattr(bpe, "REMEMBERED", 20 * bpe.ENTRY)
    monkeypatch.setattr(bitplane, "UNIT_BYTES", 20 * bpe.ENTRY)
    words, texts = kind(tokenizer_path()), _odd_texts()[:400]
    for at in range(0, 400, 50):
        ours = [np.frombuffer(ids, np.int32).tolist() for ids in words.encode(texts[at : at + 50])]
        assert words.units.bytes >= 0 and ours == [e.ids for e in library.encode_batch(texts[at : at + 50], add_special_tokens=False)]


def test_pieces_that_many_units_share_reach_the_library_once(library, monkeypatch):
    words, given = bitplane.LibraryVocabulary(tokenizer_path()), []
    coded = words.coded
    monkeypatch.setattr(words, "coded", lambda texts: coded(given.extend(texts) or texts))
    texts = [f"so zebra{mark} zebra{mark}\nzebra" for mark in ".,;:!?)\"'%&"] * 3
    ours = [np.frombuffer(ids, np.int32).tolist() for ids in words.encode(texts)]
    assert ours == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert "".join(given).count("zebra") == 2  # after a space and after a line break


def test_cuts_between_pieces_change_no_ids(library):
    source = random.Random(9)
    letters = " \n\r\tabé1.,!'s<|\u00a0\u1680\u180e\u2003\u2028\u3000\x1c\x85×÷漢ひ😀ªЖ"
    texts = ["".join(source.choices(letters, k=source.randint(0, 30))) for _ in range(5000)]
    texts[7:7] = ["", "a<|endoftext|> b", "<|endoftext|>", "", "b <|endoftext|>\n<|endoftext|>"]
    ids, counts = bitplane.LibraryVocabulary(tokenizer_path()).encode_all(pa.array([None, *texts], pa.string()).fill_null("").slice(1))
    theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(i) for i in theirs] and ids.tolist() == [i for one in theirs for i in one]


def _expected(rows, library):
    return [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]


def test_operators_on_odd_rows(spark, library):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    encoded = bpe.encode(docs, tokenizer_path())
    assert sorted(((r[0], list(r[1])) for r in encoded.collect()), key=repr) == sorted(_expected(rows, library), key=repr)
    decoded = {(r["doc_id"], r["decoded"]) for r in bpe.decode(encoded, tokenizer_path()).collect()}
    assert decoded == {(i, library.decode(ids, skip_special_tokens=False)) for i, ids in _expected(rows, library)}
    both = bpe.round_trip(docs, tokenizer_path())
    assert {(r["doc_id"], r["decoded"]) for r in both.collect()} == decoded
    assert sorted(((r[0], list(r[1])) for r in both.collect()), key=repr) == sorted(_expected(rows, library), key=repr)
    assert bpe.round_trip(empty(docs), tokenizer_path()).count() == 0
    assert bpe.decode(bpe.encode(empty(docs), tokenizer_path()), tokenizer_path()).count() == 0


def test_bpe_query(spark, folder, library):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = {(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, ids in _expected(rows, library)}
    assert {tuple(r) for r in op2_bpe(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == wanted


def test_decoder_needs_no_merges():
    tokens = bpe.token_bytes(tokenizer_path())
    assert not hasattr(tokens, "rank_of")
    ids = np.frombuffer(bpe.Vocabulary(tokenizer_path()).encode(["a word"])[0], np.int32)
    assert tokens.decode(np.array([-1, *ids, 10**6], np.int32)) == b"a word"


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    source = np.random.default_rng(1)
    docs = [(n, source.integers(0, 60_000, size).astype("<u4")) for n, size in enumerate([0, 1, 5, 70_000, 3, bitplane.BLOCK, 0])]
    docs.append((None, np.array([2**32 - 1, 0], "<u4")))
    out = io.BytesIO()
    writer = bitplane.PlaneWriter(out, bits)
    for key, ids in docs:
        writer.add(key, ids.tobytes())
    writer.close()
    reader = bitplane.PlaneReader(pa.BufferReader(out.getvalue()))
    found = list(reader.documents())
    assert [k for k, _, _ in found] == [k for k, _ in docs]
    assert all(np.array_equal(a, b) for (_, _, a), (_, b) in zip(found, docs))
    assert [s for _, s, _ in found] == np.concatenate([[0], np.cumsum([len(d) for _, d in docs])])[:-1].tolist()
    with pytest.raises(ValueError):
        bitplane.PlaneReader(pa.BufferReader(out.getvalue()[:-3]))


def test_plane_query(spark, folder, library):
    rows = sorted(tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect())
    wanted, start = set(), 0
    for i, ids in _expected(rows, library):
        whole = np.array([*ids, 2], "<u4")
        wanted.add((i, start, len(whole), zlib.crc32(whole.tobytes())))
        start += len(whole)
    assert {tuple(r) for r in op9_bitplane(spark, folder).collect()} == wanted


def test_lots_of_texts_keep_their_order(spark, folder, monkeypatch):
    docs = table(spark, folder, "documents")
    whole = {tuple(r) for r in bitplane.read(bitplane.write(docs, tokenizer_path(), files=2)).collect()}
    small = docs.repartition(3)
    assert {tuple(r) for r in bitplane.read(bitplane.write(small, tokenizer_path(), files=5)).collect()} == whole
    batches = pa.table({"key": range(9), "text": ["ab"] * 9}).to_batches(2)
    assert [[k for b in lot for k in b.column(0).to_pylist()] for lot in common.large_lots(iter(batches), 8)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]
    monkeypatch.setattr(bitplane, "LOT", 0)
    assert {tuple(r) for r in bitplane.read(bitplane.write(docs, tokenizer_path(), files=2)).collect()} == whole


def test_plane_files_of_odd_rows(spark):
    docs = documents(spark)
    found = bitplane.read(bitplane.write(docs, tokenizer_path(), files=3)).orderBy("start").collect()
    keys = [r["doc_id"] for r in found]
    assert keys == [None, *sorted(k for k in keys if k is not None)] and len(keys) == docs.count()
    assert [r["start"] for r in found[1:]] == np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()
    assert bitplane.read(bitplane.write(empty(docs), tokenizer_path())).count() == 0

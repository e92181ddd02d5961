"""Token files: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import common
from millrace.llm import token_files as tf
from millrace.llm.common import work_path

PATH = tf.default_tokenizer()


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(PATH)
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab e\n\t .,<|'s1é 　\x1c\x85日😀")), max_size=8))
def test_ids_are_the_tokenizers(texts):
    tok = Tokenizer.from_file(PATH)
    got = tf.encode_texts(pa.array(texts, pa.string()), PATH)
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["<|endoftext|> a <|endoftext|>b", "a <|endoftext|>\nb c", "x<|endoftext|>", "<|endoftext| > a"])
def test_added_tokens_are_the_tokenizers(plain, text):
    assert tf.encode_texts(pa.array(["a b", text, None]), PATH)[1].tolist() == plain(text) and (50256 in plain(text)) == ("<|endoftext|>" in text)


def test_memory_is_bounded_and_right(plain, monkeypatch):
    for words, ids in ((50, 4000), (4000, 90)):
        monkeypatch.setattr(tf, "MEMORY_WORDS", words)
        monkeypatch.setattr(tf, "MEMORY_IDS", ids)
        common._STATE.clear()
        for k in range(20):
            texts = [" ".join(f"w{(k * j) % 300}" for j in range(30 + k)), "a " + "long" * 40 + " b\0 b", "the same words", " a", "a\n", "a  b"]
            assert [g.tolist() for g in tf.encode_texts(pa.array(texts), PATH)] == [plain(t) for t in texts]
    common._STATE.clear()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.integers(0, 3))
@settings(max_examples=80, deadline=None)
def test_blocks(ranks, nulls):
    ids = [None] * nulls + [-7]
    lengths = [0] * nulls + [len(ranks)]
    block = tf.pack_block(ids, lengths, np.array(ranks, np.uint32))
    [(docs, n, back)] = list(tf.unpack_blocks(block + b"\n"))
    assert docs == ids and n.tolist() == lengths and back.tolist() == ranks


def expected(rows, plain):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(plain(r[1])))):
        ids = np.array([*plain(t), 0], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_rows(odd, odd_rows, plain):
    got = sorted((tuple(r) for r in tf.encode_documents(odd).collect()), key=lambda r: r[1])
    assert got == expected([r[:2] for r in odd_rows], plain)


def test_many_files_and_blocks(odd, odd_rows, plain, monkeypatch, spark):
    monkeypatch.setattr(tf, "FILE_IDS", 50_000)
    out = work_path(spark, "t")
    tf.write_token_files(odd, out)
    rows = tf.read_token_files(spark, out).collect()
    assert len({r["file"] for r in rows}) > 1
    texts = {(r[0], len(plain(r[1])) + 1): plain(r[1]) for r in odd_rows}
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*texts[r["doc_id"], r["n_tokens"]], 0]


def test_no_rows(none):
    assert tf.encode_documents(none).collect() == []

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from framewright.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(rows, docs, library):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=str)
    wanted = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(wanted, key=str)


@pytest.mark.parametrize("native", [False, True])
def test_odd_documents(odd, nothing, library, native):
    check(byte_bpe.encode(odd, PATH, P.PATTERN, native=native).collect(), [(r.doc_id, r.text) for r in odd.collect()], library)
    assert byte_bpe.encode(nothing, PATH, P.PATTERN, native=native).count() == 0


def test_stretches_of_space(spark, library):
    texts = ["a  b", "  x ", "\n\n a", "a \n b\t c", " ", "", "x \n", "tab\t\tx  ", " " * 200 + "z", "=-" * 100, "'s it's ' s", " x   y", "é" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = byte_bpe.encode(df, PATH, P.PATTERN).collect()
    assert all(r.decoded.decode() == texts[r.doc_id] for r in rows)
    check(rows, list(enumerate(texts)), library)


@pytest.mark.parametrize("native", [False, True])
def test_documents(spark, small, library, native):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    check(byte_bpe.encode(docs, PATH, P.PATTERN, native=native).collect(), [(r.doc_id, r.text) for r in docs.collect()], library)


def test_long_words_by_heap(library):
    ranks = library._mergeable_ranks
    for w in (b"a" * 1000, b"abcabd" * 60, "ünïcödé".encode() * 30, bytes(range(256)), b"=-" * 99):
        assert byte_bpe.merge_long(w, ranks) == library._encode_single_piece(w)


def test_the_known_pattern_and_another(spark, library):
    assert byte_bpe.SPACED == P.PATTERN
    text = "It's  a-b 12 ünï, x!! \n\n y"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = byte_bpe.encode(df, PATH, r"\w+|\W").collect()[0]
    assert row.decoded.decode() == text

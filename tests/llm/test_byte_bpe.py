import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids(bpe, text):
    data = bpe.encode(text)
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_tokens_encode_to_themselves(bpe):
    """What the proof of stable seams needs."""
    assert all(bpe.merged(t) == [t] for t in bpe.ranks)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abethinor  \n\t1'sé漢🙂-\x1c\x85 "), max_size=80))
def test_as_the_library(text):
    bpe = byte_bpe.load(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    assert ids(bpe, text) == library.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1501, "aab" * 700 + "x" * 777, "漢字" * 600, "theinor" * 900])
def test_long_pieces(bpe, library, text):
    assert ids(bpe, text) == library.encode_ordinary(text)


def test_tree_is_the_encoding(bpe):
    rnd = random.Random(1)
    for _ in range(200):
        data = bytes(rnd.choice(b"abcdethinor \xc3\xa9") for _ in range(rnd.randint(1, 400)))
        assert bpe.tree(data) == bpe.merged(data) == bpe._merged_long(data)


def test_round_trip_of_a_table(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (None, "é" * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.round_trip(docs.select("doc_id", "text"), PATH, public_tokenizers.PATTERN).collect()
    import hashlib

    want = []
    for i, text, _ in rows:
        own = library.encode_ordinary(text or "")
        want.append((i, len(own), hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    encoded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)  # a column of the same name is replaced
    arrays = encoded.where("doc_id = 3").select(byte_bpe.ids_as_array(encoded.ids).alias("a")).first()["a"]
    assert arrays == library.encode_ordinary("Hello  world") and encoded.where("doc_id = 2").select(byte_bpe.ids_as_array(encoded.ids)).first()[0] == []


def test_pieces_of_the_table_go_through_the_tree(spark, library):
    """Of the pieces that aren't tokens and have more bytes than a leaf all are joined over seams, and the whole table's ids are the library's."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    own = byte_bpe.ByteBpe(byte_bpe.load(PATH, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    missed = {x.encode() for _, t in docs for x in own.pattern.findall(t)} - set(own.ranks)
    split = []
    for x in missed:
        own.trees.clear()
        own.seams = 0
        assert own.tree(x) == own.merged(x)
        split.append(own.seams > 0)
    assert len(missed) > 10_000 and sum(split) == sum(len(x) > byte_bpe.LEAF for x in missed) > 0.9 * len(missed)
    import hashlib

    got = {r.doc_id: r for r in byte_bpe.round_trip(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), PATH, public_tokenizers.PATTERN).collect()}
    for i, text in docs:
        ids = library.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(none, PATH, public_tokenizers.PATTERN).collect() == []

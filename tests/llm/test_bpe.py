"""BPE against the tokenizers library, byte for byte."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
FIXED = ["", " ", "\n\n  x", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", "It's we'll I'D", "x" * 3000, " " * 700, "日本語テキスト", "\x1c\x1d a\x85b\xa0c ", "é ½ ٣", "\U0001f600‍", "0 1 22", "\r\n\t tab", "\x00\x01", "᠎﻿​"]


def same(text: str) -> None:
    own, ids = bpe.codec(PATH), LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", FIXED)
def test_fixed(text):
    same(text)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    same(text)


@given(st.text(alphabet="ab '<|>endoftx\n é", max_size=80))
@settings(max_examples=200, deadline=None)
def test_near_special(text):
    same(text)


@given(st.text(alphabet="abcdeéxyz01", min_size=1, max_size=300))
@settings(max_examples=150, deadline=None)
def test_long_words_merge_alike(text):
    own = bpe.codec(PATH)
    for word in (text, "ab" * len(text), text * 3):
        data = word.encode()
        assert own.merge_long(data) == (own.merge(data) if len(data) <= bpe.SCAN_BYTES else tuple(LIBRARY.encode(word, add_special_tokens=False).ids)) or not word.isalpha()


def test_a_megabyte_without_spaces():
    import random
    import time

    text = "".join(random.Random(3).choices("abcdefghij", k=1 << 20))
    own, began = bpe.codec(PATH), time.perf_counter()
    ids = own.encode(text)
    assert time.perf_counter() - began < 60
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="vocabulary"):
            bpe.Codec(str(path))


def test_repeated_rows_and_clashing_columns(docs):
    from pyspark.sql import functions as F

    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, None), (None, None)]
    d = docs(rows).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = bpe.tokenised(d).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [0, 0, 1, 2, 2]


def test_query(spark, docs):
    rows = {r["doc_id"]: r for r in bpe.digests(docs([(1, "the cat"), (2, None), (3, ""), (4, "the cat"), (None, "x")])).collect()}
    ids = LIBRARY.encode("the cat", add_special_tokens=False).ids
    assert rows[1]["ids_sha256"] == rows[4]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[1]["decoded_sha256"] == hashlib.sha256(b"the cat").hexdigest()
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0
    assert len(rows) == 5
    assert bpe.digests(docs([])).count() == 0
    assert bpe.encoded(docs([(1, "the cat")])).first()["ids"] == ids

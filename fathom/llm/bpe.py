"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A text is cut at the vocabulary's added tokens, then into words by the published pattern. Each distinct word
is merged in one short list of part boundaries with, beside each, the rank of joining that part with the next:
the smallest rank is found by a scan, its right boundary deleted, and the two ranks beside it looked up anew.
Words are short, so the scan beats a heap, and the results of recent words are kept per worker (at most
MEMO words, then the memo starts again). A word of more than SCAN_BYTES (text without spaces) keeps its boundaries
and ranks in linked lists and finds the smallest rank by a heap: the same merges in the same order.

Null texts are empty; empty texts have no ids; whole texts of any length are encoded; texts whose bytes are no
UTF-8 after decoding cannot arise from encoding, but decode() replaces them. Repeated rows give repeated rows; an empty
table gives none. Other columns are ignored. A vocabulary file that asks for anything else than plain byte-level
merging (a normaliser, a leading space, other word patterns, affixes) is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fathom.llm.common import reachable, table

MEMO = 400_000
#: Longest word whose result is kept.
MEMO_CHARS = 48
#: Longest word that is merged by scans.
SCAN_BYTES = 256
NONE = 1 << 60
#: The published pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself if printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def checked(spec: dict) -> dict:
    """The file's content, if this codec does all that it asks for."""
    model, words = spec["model"], spec.get("pre_tokenizer") or {}
    strange = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    strange += ["normalizer"] if spec.get("normalizer") else []
    strange += ["pre_tokenizer"] if (words.get("type"), words.get("add_prefix_space"), words.get("use_regex", True)) != ("ByteLevel", False, True) else []
    strange += ["decoder"] if (spec.get("decoder") or {}).get("type") != "ByteLevel" else []
    strange += [f"added token {x['content']}" for x in spec["added_tokens"] if any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model.get("type", "BPE") != "BPE" or strange:
        raise ValueError(f"no plain byte-level vocabulary: {', '.join(strange) or model['type']}")
    return spec


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[raw(left), raw(right)] = rank
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(PATTERN).findall
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word."""
        whole = self.ids.get(word)
        if len(word) == 1:
            return (whole,)
        if len(word) > SCAN_BYTES:
            return self.merge_long(word)
        get, starts = self.ranks.get, list(range(len(word) + 1))
        ranks = [get((word[i : i + 1], word[i + 1 : i + 2]), NONE) for i in range(len(word) - 1)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            del starts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((word[starts[i] : starts[i + 1]], word[starts[i + 1] : starts[i + 2]]), NONE)
            if i:
                ranks[i - 1] = get((word[starts[i - 1] : starts[i]], word[starts[i] : starts[i + 1]]), NONE)
        ids = self.ids
        return tuple([ids[word[a:b]] for a, b in zip(starts, starts[1:], strict=False)])

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """As merge(), in n log n steps: parts are named by their first byte, and a heap holds (rank, part, ends) of its joins.

        An entry is stale if its part is gone or either part has grown since.
        """
        get, n = self.ranks.get, len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := get((word[i:j], word[j : after[j]]))) is not None:
                heapq.heappush(heap, (r, i, after[j]))

        while heap:
            rank, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end or get((word[i:j], word[j:end])) != rank:
                continue
            alive[j], after[i] = 0, end
            if end < n:
                before[end] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ids[word[i : after[i]]])
            i = after[i]
        return tuple(out)

    def learn(self, word: str) -> tuple[int, ...]:
        out = self.merge(word.encode())
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = out
        return out

    def plain(self, text: str, out: list[int]) -> None:
        get, learn, extend = self.memo.get, self.learn, out.extend
        for word in self.words(text):
            extend(get(word) or learn(word))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            self.plain(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self.plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of every row."""
    return _mapped(docs, path, "doc_id long, ids array<int>, decoded string", lambda ids, text: (np.array(ids, np.int32), text), [pa.list_(pa.int32()), pa.string()])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def each(ids: list[int], text: str) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", each, [pa.int64(), pa.string(), pa.string()])


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every row."""

    def each(ids: list[int], text: str) -> tuple:
        return len(ids), np.array(ids, np.int32), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, path, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", each, [pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string()])


def _mapped(docs: DataFrame, path: str | None, schema: str, each, kinds: list[pa.DataType]) -> DataFrame:
    reachable(docs.sparkSession)
    path = path or default_vocabulary()
    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = []
                for text in part.column(1):
                    ids = own.encode(text.as_py() or "")
                    rows.append(each(ids, own.decode(ids)))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

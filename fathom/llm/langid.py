"""Language identification by cross-parsing against suffix automata.

Per language, a bounded sample of labelled rows (TRAIN_DOCS rows at most, in the order of a hash, and no more than
bring TRAIN_LETTERS letters and word ends together; whole rows, the longer ones last, one at least) becomes a suffix
automaton. A text's letters, lower-cased, with one space behind each word, are parsed from left to right into the
longest phrases that occur in that sample, across words; a text of the same language needs fewer. Counts are
normalised by log2 of the sample's length; the smallest wins, ties by name. score is the winner's share of
the inverse costs, raised to SHARPNESS.

The texts of a batch are parsed in lockstep, one letter of each and all languages at a time; when few are left, the
longest go on letter by letter, so whole texts of any length are parsed.

Null texts and texts without a letter are `und` with score 0, and so are all texts if nothing is labelled. An empty
table gives none; repeated rows give repeated rows, and teach once. Only text and a non-null lang of training rows are learned
from. Rows with a null id count as remainder 0. Other columns are ignored. More than MOST_LANGS languages are an error.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import blocks, reachable, table, utf8

TRAIN_DOCS, TRAIN_LETTERS, LONGER = 400, 60_000, 6_000
#: With more languages than this at the full TRAIN_LETTERS, each gets a smaller share, so that automata stay some 100 MB.
FULL_LANGS, MOST_LANGS = 8, 1000
SALTS = 32
#: Characters of the texts parsed in lockstep at a time, and how few texts go on one by one.
TOGETHER, ALONE = 1 << 22, 16
SHARPNESS = 12
LETTERS = re.compile(r"[^\W\d_]+")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % n


class Automaton:
    """Suffix automaton of a text: state 0 reads the empty string, every path from it a substring."""

    def __init__(self, text: str):
        step, link, length, last = [{}], [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
            last = new
        flat = [(s << 21 | ord(c), t) for s, moves in enumerate(step) for c, t in moves.items()]
        self.keys = np.array([k for k, _ in flat], np.int64)
        self.to = np.array([t for _, t in flat], np.int32)


def phrases(moves: dict[int, int], text: str) -> int:
    """The number of longest-match phrases of `text`; a letter that never occurs is a phrase of its own."""
    n, state = 0, 0
    for c in map(ord, text):
        nxt = moves.get(state << 21 | c)
        if nxt is None:
            n += state != 0
            nxt = moves.get(c, 0)
            n += nxt == 0
        state = nxt
    return n + (state != 0)


class Parser:
    """All languages' automata as one flat table: a row of `width` letters a state, named by where it starts.

    The last letter of a row stands for those of no sample; -1 where nothing follows.
    """

    def __init__(self, automata: list[tuple[np.ndarray, np.ndarray]]):
        letters = np.unique(np.concatenate([keys & 0x1FFFFF for keys, _ in automata]))
        self.column = np.full(0x110000, len(letters), np.uint16)
        self.column[letters] = np.arange(len(letters))
        states = [int(to.max()) + 1 for _, to in automata]
        width = len(letters) + 1
        kind = np.int32 if sum(states) * width < 2**31 else np.int64
        self.roots = np.cumsum([0, *states[:-1]]).astype(kind) * width
        self.table = np.full(sum(states) * width, -1, kind)
        for root, (keys, to) in zip(self.roots, automata, strict=True):
            self.table[root + (keys >> 21) * width + self.column[keys & 0x1FFFFF]] = root + to * width
        self.anew = self.table[self.roots[:, None] + np.arange(width)]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of longest-match phrases of each text (a row) by each language (a column)."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        n = np.array([len(texts[i]) for i in order])
        codes = self.column[np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le"), np.uint32)]
        start, langs = np.cumsum(n) - n, len(self.roots)
        state = np.tile(self.roots, (len(n), 1))
        found = np.zeros(state.shape, np.int64)
        flat, at, live, shorter = found.ravel(), 0, int(np.searchsorted(-n, 0)), -n
        while live > ALONE:
            c = codes[start[:live] + at]
            now = state[:live]
            step = self.table.take(now + c[:, None])
            dead = np.flatnonzero(step.ravel() < 0)
            row, lang = np.divmod(dead, langs)
            root, new = self.roots[lang], self.anew[lang, c[row]]
            flat[dead] += (now.ravel()[dead] != root).astype(np.int64) + (new < 0)
            step.ravel()[dead] = np.where(new < 0, root, new)
            state[:live] = step
            at += 1
            live = int(np.searchsorted(shorter, -at))
        for row in range(live):
            rest = codes[start[row] + at : start[row] + n[row]].tolist()
            for lang in range(langs):
                found[row, lang], state[row, lang] = self._alone(rest, lang, int(state[row, lang]), int(found[row, lang]))
        found += state != self.roots
        out = np.empty_like(found)
        out[order] = found
        return out

    def _alone(self, codes: list[int], lang: int, state: int, found: int) -> tuple[int, int]:
        item, root, anew = self.table.item, int(self.roots[lang]), self.anew[lang].tolist()
        for c in codes:
            step = item(state + c)
            if step < 0:
                found += state != root
                step = anew[c]
                if step < 0:
                    found, step = found + 1, root
            state = step
        return found, state


_parser: dict = {}


def letters_of(text: str | None) -> str:
    """The lower-case letters of a text, a space behind each word."""
    words = LETTERS.findall((text or "").lower())
    return " ".join(words) + " " if words else ""


def learn(docs: DataFrame, held: Column) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, sample length, automaton) of each language of the rows that are not held out."""
    reachable(docs.sparkSession)
    rows = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("text").alias("t"), "text")
    slim = rows.select("doc_id", "lang", "t", (F.length("text") > LONGER).alias("longer"), F.xxhash64("doc_id", "t").alias("at")).withColumn("salt", F.pmod("at", F.lit(SALTS)))
    order = ("longer", "at", "doc_id", "t")
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= TRAIN_DOCS)
    picked = first(first(slim, "lang", "salt"), "lang").select(F.col("doc_id").alias("id_"), F.col("lang").alias("lang_"), F.col("t").alias("t_"), "longer", "at").distinct()
    n_langs = picked.select("lang_").distinct().limit(MOST_LANGS + 1).count()
    if n_langs > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("doc_id", "lang", "t")]
    picked = picked.withColumnRenamed("id_", "doc_id_")
    sample = rows.join(F.broadcast(picked), same).select("lang", "longer", "at", "text").dropDuplicates(["lang", "at"])  # TRAIN_DOCS * MOST_LANGS ids at most
    words = sample.mapInArrow(_letters, "lang string, longer boolean, at long, letters string").where("letters <> ''")
    most = TRAIN_LETTERS * min(1.0, FULL_LANGS / max(1, n_langs))
    sofar = Window.partitionBy("lang").orderBy("longer", "at")
    kept = words.withColumn("upto", F.sum(F.length("letters")).over(sofar)).where((F.col("upto") <= most) | (F.col("upto") == F.length("letters")))
    texts: dict[str, list[str]] = {}
    for r in kept.orderBy("lang", "longer", "at").toLocalIterator():  # `most` letters a language, or one row
        texts.setdefault(r["lang"], []).append(r["letters"])
    out = []
    for lang in sorted(texts):
        text = "".join(texts[lang])
        made = Automaton(text)
        out.append((lang, len(text), made.keys, made.to))
    return out


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [letters_of(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(words, pa.string())], names=["lang", "longer", "at", "letters"])


def predict(docs: DataFrame, learned: list[tuple[str, int, np.ndarray, np.ndarray]], held: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is read for a prediction."""
    spark = docs.sparkSession
    reachable(spark)
    shared = spark.sparkContext.broadcast([(k, t) for _, _, k, t in learned])  # some MB a language, FULL_LANGS in full
    langs, token = [x[0] for x in learned], uuid.uuid4().hex
    cost = np.array([math.log2(max(2, x[1])) for x in learned])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs and _parser.get("of") != token:
            _parser.clear()
            _parser.update(of=token, parser=Parser(shared.value))
        for b in batches:
            for lo, hi in blocks(utf8(b.column(2))[1], TOGETHER):
                part = b.slice(lo, hi - lo)
                streams = [letters_of(x.as_py()) if langs else "" for x in part.column(2)]
                some = [i for i, x in enumerate(streams) if x]
                names, scores = ["und"] * part.num_rows, [0.0] * part.num_rows
                if some:
                    n = _parser["parser"].counts([streams[i] for i in some]) * cost
                    best = n.argmin(1)
                    least = n[np.arange(len(some)), best]
                    share = 1 / ((least[:, None] / n) ** SHARPNESS).sum(1)
                    for i, k, x in zip(some, best.tolist(), share.tolist(), strict=True):
                        names[i], scores[i] = langs[k], x
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    return predict(docs, learn(docs, held), held)

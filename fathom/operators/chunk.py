"""Chunkers: documents (id, text) to rows (id, pos, text)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import sentences, stripped


#: Windows that are cut from one piece of the text.
RUN = 16


def windows(docs: DataFrame, key: str, size: int, overlap: int, min_chars: int = 1, pure_tail: bool = True, strip: bool = True) -> DataFrame:
    """Fixed windows of `size` characters every size - overlap.

    pure_tail: also the last window when it only repeats the overlap. Windows with fewer than min_chars
    characters (after stripping) are dropped; pos numbers windows before that.
    """
    step = size - overlap
    n = F.length("text")
    last = n - 1 if pure_tail else F.greatest(F.lit(0), n - overlap - 1)
    # cut by runs of windows, then by windows: a substring counts characters from its text's start
    runs = F.transform(F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step * RUN))), lambda i: F.struct(i.alias("at"), F.substring(F.col("text"), i + 1, F.lit(step * (RUN - 1) + size)).alias("part")))
    offsets = lambda at: F.sequence(F.lit(0), F.least(last - at, F.lit(step * (RUN - 1))), F.lit(step))
    pieces = F.flatten(F.transform(runs, lambda r: F.transform(offsets(r["at"]), lambda o: F.struct((r["at"] + o).alias("start"), F.substring(r["part"], o + 1, F.lit(size)).alias("text")))))
    cut = docs.select(key, F.posexplode(pieces).alias("pos", "piece")).select(key, "pos", "piece.start", F.col("piece.text").alias("text"))  # cut before the explode: its rows do not carry the whole text
    return cut.select(key, "pos", "start", (stripped(F.col("text")) if strip else F.col("text")).alias("text")).where(F.length("text") >= min_chars)


def sentence_rows(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.posexplode(sentences(F.col("text"))).alias("pos", "text"))


def sentence_groups(docs: DataFrame, key: str, per_chunk: int = 5, overlap: int = 1, min_chars: int = 40) -> DataFrame:
    """per_chunk sentences joined by spaces, the next chunk starting `overlap` sentences before the last one's end."""
    step = max(1, per_chunk - overlap)
    split = docs.select(key, sentences(F.col("text")).alias("s"))
    joined = F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(step)), lambda i: F.array_join(F.slice("s", i + 1, per_chunk), " "))
    cut = split.select(key, F.posexplode(joined).alias("pos", "text"))  # joined before the explode: its rows do not carry all sentences
    return cut.select(key, "pos", stripped(F.col("text")).alias("text")).where(F.length("text") >= min_chars)


def sentence_windows(docs: DataFrame, key: str, around: int = 2) -> DataFrame:
    """Each sentence with its neighbours: (key, pos, text, context)."""
    s = docs.select(key, sentences(F.col("text")).alias("s")).select(key, "s", F.posexplode("s").alias("pos", "text"))
    first = F.greatest(F.lit(1), F.col("pos") + 1 - around)
    return s.select(key, "pos", "text", F.array_join(F.slice("s", first, F.col("pos") + 2 + around - first), " ").alias("context"))


def strips(docs: DataFrame, key: str, more_than: int = 20) -> DataFrame:
    """Stripped sentences longer than `more_than` characters."""
    return sentence_rows(docs, key).select(key, "pos", stripped(F.col("text")).alias("text")).where(F.length("text") > more_than)


def small_to_big(docs: DataFrame, key: str, parent: int = 1500, child: int = 250) -> DataFrame:
    """Children inside parents, both without overlap: (key, parent_pos, pos, text)."""
    big = windows(docs, key, parent, 0, strip=False).select(key, F.col("pos").alias("parent_pos"), "text")
    pieces = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(child)), lambda i: F.substring(F.col("text"), i + 1, F.lit(child)))
    cut = big.select(key, "parent_pos", F.posexplode(pieces).alias("pos", "text"))
    return cut.select(key, "parent_pos", "pos", stripped(F.col("text")).alias("text")).where("text <> ''")


def sections(chunks: DataFrame, key: str, members: int = 5) -> DataFrame:
    """Consecutive chunks joined: (key, section, n_chunks, text)."""
    numbered = chunks.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    grouped = numbered.groupBy(key, F.floor(F.col("n__") / members).cast("long").alias("section"))
    return grouped.agg(F.count(F.lit(1)).alias("n_chunks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n__", "text"))), lambda x: x["text"]), " ").alias("text"))


def headed(docs: DataFrame, key: str, levels: int = 3) -> DataFrame:
    """Markdown by headings: (key, pos, path, text); path joins the open headings, a heading closes those below it."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    level = F.length(F.regexp_extract("raw", rf"^(#{{1,{levels}}})\s+\S", 1))
    lines = lines.withColumn("level", level).withColumn("title", F.regexp_extract("raw", rf"^#{{1,{levels}}}\s+(.*?)\s*$", 1))
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("pos", F.sum((F.col("level") > 0).cast("int")).over(so_far))
    for i in range(1, levels + 1):
        mine = F.last(F.when(F.col("level").between(1, i), F.struct(F.col("level").alias("l"), F.col("title").alias("t"))), ignorenulls=True).over(so_far)
        lines = lines.withColumn(f"h{i}", F.when(mine["l"] == i, mine["t"]))
    body = lines.where("level = 0").groupBy(key, "pos").agg(*[F.max(f"h{i}").alias(f"h{i}") for i in range(1, levels + 1)], F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("rows"))
    text = stripped(F.array_join(F.transform("rows", lambda x: x["raw"]), "\n"))
    return body.select(key, "pos", F.concat_ws(" > ", *[f"h{i}" for i in range(1, levels + 1)]).alias("path"), text.alias("text")).where("text <> ''")


def html_sections(pages: DataFrame, key: str) -> DataFrame:
    """HTML pages by <h1> to <h3>: (key, pos, heading, text) with tags removed and white space collapsed."""
    parts = F.split("html", r"(?=<h[1-3][ >])")
    rows = pages.select(key, F.posexplode(parts).alias("pos", "part"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    heading = plain(F.regexp_extract("part", r"(?s)^<h[1-3][^>]*>(.*?)</h[1-3]>", 1))
    return rows.select(key, "pos", heading.alias("heading"), plain(F.regexp_replace("part", r"(?s)^<h[1-3][^>]*>.*?</h[1-3]>", "")).alias("text")).where("text <> ''")


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator that occurs, recursing into long pieces, then merges greedily.

    A separator stays at the start of the piece it precedes. Chunks have at most `size` characters and carry
    over at most `overlap` from the chunk before; they are stripped, blank ones dropped.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in [first, *(sep + x for x in others)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for piece in pieces:
        if len(piece) > size and finer:
            flush()
            held.clear()
            out.extend(split_recursively(piece, size, overlap, finer))
            continue
        total = sum(map(len, held))
        if held and total + len(piece) > size:
            flush()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
    flush()
    return out


def recursive(docs: DataFrame, key: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS, min_chars: int = 1) -> DataFrame:
    """Recursive splitting: no built-in expresses the merge, so texts go through Arrow batches."""

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursively(t or "", size, overlap, separators))

    return docs.select(key, F.posexplode(pieces("text")).alias("pos", "text")).where(F.length("text") >= min_chars)


#: Words whose hashes a worker remembers.
MEMO = 200_000
_cells: dict[tuple[str, int], tuple[int, int]] = {}


def bag_vector(text: str, dims: int) -> list[int]:
    """Signed feature hashing of a text's words (between spaces) into `dims` whole numbers."""
    out = [0] * dims
    for w in text.split(" "):
        if w:
            cell = _cells.get((w, dims))
            if cell is None:
                if len(_cells) >= MEMO:
                    _cells.clear()
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                cell = _cells[w, dims] = h % dims, 1 - 2 * (h // dims % 2)
            out[cell[0]] += cell[1]
    return out


def _dot(a: list, b: list) -> float:
    return sum(map(mul, a, b))


def adjacent_cosines(texts: list[str], dims: int) -> list[float | None]:
    """Each text's cosine with the one before, 0 where either has no weight; the first has None."""
    vectors = [bag_vector(t, dims) for t in texts]
    norms = [math.sqrt(_dot(v, v)) for v in vectors]
    return [None if i == 0 else _dot(vectors[i - 1], vectors[i]) / (norms[i - 1] * norms[i]) if norms[i - 1] and norms[i] else 0.0 for i in range(len(texts))]


def mean_cosine(texts: list[str], dims: int) -> float | None:
    """The mean cosine of a chunk's pairs of sentences, None for fewer than two: (|sum of units|^2 - units) / (n (n - 1))."""
    if len(texts) < 2:
        return None
    total, m = np.zeros(dims), 0
    for v in (bag_vector(t, dims) for t in texts):
        if n := math.sqrt(_dot(v, v)):
            total += np.array(v) / n
            m += 1
    return float((total * total).sum() - m) / (len(texts) * (len(texts) - 1))


def _row_wise(rule: Callable, kind: str, dims: int) -> Callable[[Column], Column]:
    """`rule` over each row's value, in Arrow batches: hashing words is no built-in's work, and the rows need no shuffle so."""

    @F.pandas_udf(kind)
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: rule(x, dims))

    return run


def _lowered(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.lower(x))


def adjacent_similarity(docs: DataFrame, key: str, dims: int = 32) -> DataFrame:
    """(key, pos, text, sim): each sentence's cosine with the one before, 0 where either has no weight; the first has null."""
    rows = docs.where("text IS NOT NULL").select(key, sentences(F.col("text")).alias("s")).withColumn("sim", _row_wise(adjacent_cosines, "array<double>", dims)(_lowered(F.col("s"))))
    return rows.select(key, F.posexplode(F.arrays_zip("s", "sim")).alias("pos", "z")).select(key, "pos", F.col("z.s").alias("text"), "z.sim")


def semantic(docs: DataFrame, key: str, threshold: float = 0.6, dims: int = 32) -> DataFrame:
    """Sentences joined while each resembles the one before at least by `threshold`: (key, pos, n_sentences, text). No shuffle."""
    rows = docs.where("text IS NOT NULL").select(key, sentences(F.col("text")).alias("s")).withColumn("sim", _row_wise(adjacent_cosines, "array<double>", dims)(_lowered(F.col("s"))))
    opens = F.transform("sim", lambda x, i: F.when((i == 0) | (x < threshold), i).otherwise(-1))
    starts = rows.select(key, "s", F.filter(opens, lambda i: i >= 0).alias("at"))
    cut = starts.select(key, "s", "at", F.posexplode("at").alias("pos", "start"))
    n = F.coalesce(F.get("at", F.col("pos") + 1), F.size("s")) - F.col("start")
    return cut.select(key, "pos", n.cast("long").alias("n_sentences"), F.array_join(F.slice("s", F.col("start") + 1, n), " ").alias("text"))


def coherence(chunks: DataFrame, key: str, dims: int = 32) -> DataFrame:
    """Per document the mean, over chunks of two or more sentences, of the mean cosine of their sentence pairs; 0 if none.

    The sum over pairs is (|sum of units|^2 - n) / 2, so that no pairs are made; one shuffle, for the documents' means.
    """
    rows = chunks.where("text IS NOT NULL").select(key, _row_wise(mean_cosine, "double", dims)(_lowered(sentences(F.col("text")))).alias("c"))
    return rows.groupBy(key).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("coherence"))


def best_strategy(docs: DataFrame, key: str, strategies: dict[str, Callable[[DataFrame], DataFrame]], dims: int = 32) -> DataFrame:
    """(key, strategy, coherence) of the most coherent strategy; ties by the order given."""
    scored = None
    for i, (name, make) in enumerate(strategies.items()):
        one = coherence(make(docs), key, dims).select(key, F.lit(i).alias("i"), F.lit(name).alias("strategy"), F.round("coherence", 6).alias("coherence"))
        scored = one if scored is None else scored.union(one)
    return scored.groupBy(key).agg(F.max_by(F.struct("strategy", "coherence"), F.struct("coherence", -F.col("i"))).alias("b")).select(key, "b.*")


def pooled(chunks: DataFrame, key: str, dims: int = 32, weight: float = 0.5) -> DataFrame:
    """Late chunking in long form: each chunk's mean word vector plus `weight` of its document's: (key, pos, dim, w).

    Vectors are made inside the chunks' rows; one shuffle brings a document's together.
    """
    n = F.size(F.filter(F.split(F.lower("text"), " "), lambda w: w != ""))
    own = chunks.select(key, "pos", n.alias("n"), "text").where("n > 0").select(key, "pos", "n", _row_wise(bag_vector, "array<long>", dims)(F.lower("text")).alias("v"))
    whole = own.groupBy(key).agg(F.collect_list(F.struct("pos", "n", "v")).alias("c"), F.sum("n").alias("nd"))  # one document's chunks
    dims_of = F.sequence(F.lit(0), F.lit(dims - 1))
    sums = F.transform(dims_of, lambda d: F.struct(d.alias("dim"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["v"][d]).alias("wd"), F.exists("c", lambda x: x["v"][d] != 0).alias("some")))
    spread = whole.withColumn("sums", F.filter(sums, lambda x: x["some"])).select(key, "nd", "sums", F.explode("c").alias("x"))
    long = spread.select(key, F.col("x.pos").alias("pos"), F.col("x.n").alias("n"), F.col("x.v").alias("v"), "nd", F.explode("sums").alias("y"))
    return long.select(key, "pos", F.col("y.dim").alias("dim"), (F.get("v", F.col("y.dim")) / F.col("n") + weight * F.col("y.wd") / F.col("nd")).alias("w"))


def parsed_propositions(outputs: DataFrame, text: str = "text", output: str = "output") -> Column:
    """A generator's JSON list of facts; the whole text if the output is no list."""
    return F.coalesce(F.from_json(F.col(output), "array<string>"), F.array(F.col(text)))


def by_boundaries(docs: DataFrame, key: str, boundary: Callable[[Column, Column], Column]) -> DataFrame:
    """Sentences grouped by a pluggable rule: a chunk starts where boundary(previous sentence, sentence) holds."""
    s = sentence_rows(docs, key)
    order = Window.partitionBy(key).orderBy("pos")
    new = F.coalesce(boundary(F.lag("text").over(order), F.col("text")), F.lit(False)).cast("int")
    s = s.withColumn("new", new).withColumn("chunk", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, F.col("chunk").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def dense_ids(rows: DataFrame, order: list[str], name: str = "chunk_id", cells: int = 64) -> DataFrame:
    """Gapless ids from 0 in the order given, without one task that sees all rows.

    The first column's values are grouped by hash for counting; each value's first id is a running sum over
    the distinct values' counts, in `cells` ranges of equal hash-free order (by approximate quantiles).
    """
    first, *rest = order
    counts = rows.groupBy(first).agg(F.count(F.lit(1)).alias("n__"))
    cuts = counts.agg(F.percentile_approx(first, [i / cells for i in range(1, cells)], 1000).alias("cuts__"))
    celled = counts.crossJoin(F.broadcast(cuts)).withColumn("cell__", F.size(F.filter("cuts__", lambda c: c < F.col(first)))).drop("cuts__")  # one row
    per_cell = celled.groupBy("cell__").agg(F.sum("n__").alias("c__"))
    before = Window.orderBy("cell__").rowsBetween(Window.unboundedPreceding, -1)  # `cells` rows
    offsets = per_cell.select("cell__", F.coalesce(F.sum("c__").over(before), F.lit(0)).alias("o__"))
    inside = Window.partitionBy("cell__").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.join(F.broadcast(offsets), "cell__").select(first, (F.col("o__") + F.coalesce(F.sum("n__").over(inside), F.lit(0))).alias("s__"))  # `cells` rows
    numbered = rows.withColumn("r__", F.row_number().over(Window.partitionBy(first).orderBy(*rest)))
    return numbered.join(starts, first).withColumn(name, (F.col("s__") + F.col("r__") - 1).cast("long")).drop("s__", "r__")


CHUNKERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "fixed": lambda d, k: windows(d, k, 400, 50, 40),
    "recursive": lambda d, k: recursive(d, k, 400, 50, ("\n\n", "\n", ". ", " ", ""), 40),
    "sentence": lambda d, k: sentence_groups(d, k),
}

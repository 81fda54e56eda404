"""Routing, parsing of graders' outputs, verdicts, refinement, compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.text import ordered_join, sentences, stripped, tagged, tokens

# The router's markers.
COMPOUND_MARKERS = (" and ", " as well as ")
VAGUE_MARKERS = ("dont", "didnt", "just ", "how come", "everyone", "like everyone")
NEEDS_CONTEXT_MARKERS = ("value", "rate did", "parameter")
BROAD_MARKERS = ("why is", "why did", "what lets", "what makes", "how does")


def heuristic_route(text: Column) -> Column:
    """The first rule that fits, else CLEAR."""
    q = F.lower(text)
    has = lambda markers: F.greatest(*[F.instr(q, m) for m in markers]) > 0
    one_question = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) <= 1
    compound = has(COMPOUND_MARKERS) & one_question & F.contains(text, F.lit(","))
    return F.when(compound, "COMPOUND").when(has(VAGUE_MARKERS), "VAGUE").when(has(NEEDS_CONTEXT_MARKERS), "NEEDS_CONTEXT").when(has(BROAD_MARKERS), "BROAD").otherwise("CLEAR")


def known_route(answer: Column) -> Column:
    """A model's category; unknown ones are CLEAR."""
    a = F.upper(F.trim(answer))
    return F.when(a.isin("CLEAR", "VAGUE", "COMPOUND", "BROAD", "NEEDS_CONTEXT"), a).otherwise("CLEAR")


def parsed_scores(output: Column, n: Column) -> Column:
    """n scores of 1 to 5 from <scores>a,b,...</scores>; 1 where one is missing or no number."""
    parts = F.split(F.replace(tagged(output, "scores"), F.lit(" "), F.lit("")), ",")
    one = lambda i: F.coalesce(F.when(F.get(parts, i).rlike("^[0-9]+$"), F.greatest(F.lit(1), F.least(F.lit(5), F.get(parts, i).try_cast("int")))), F.lit(1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def verdict(scores: Column, upper: int = 4, lower: int = 2) -> Column:
    top = F.coalesce(F.array_max(scores), F.lit(1))
    return F.when(top >= upper, "Correct").when(top <= lower, "Incorrect").otherwise("Ambiguous")


def parsed_order(output: Column, n: Column) -> Column:
    """A permutation of 1..n from <ranking>a,b,...</ranking>: bad and repeated places drop, missing ones follow in order."""
    parts = F.split(F.replace(tagged(output, "ranking"), F.lit(" "), F.lit("")), ",")
    given = F.array_distinct(F.filter(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))), lambda x: x.isNotNull() & x.between(1, n)))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.concat(given, F.array_except(every, given))


def parsed_lines(output: Column) -> Column:
    """The non-blank lines of a generator's list, without leading dashes and spaces."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^[- ]+|[- ]+$", ""))


def refined(chunks: DataFrame, judge, threshold: int = 3) -> DataFrame:
    """Chunks (query_id, query, rank, text) cut to the sentences of over 20 characters that judge(query, sentence) rates at
    least `threshold`; a query of which nothing is left keeps its chunks. (query_id, text)."""
    s = chunks.select("query_id", "query", "rank", F.posexplode(sentences(F.col("text"))).alias("pos", "s")).withColumn("s", stripped(F.col("s"))).where(F.length("s") > 20)
    kept = s.where(judge(F.col("query"), F.col("s")) >= threshold).select("query_id", F.struct("rank", "pos").alias("rank"), F.col("s").alias("text"))
    good = kept.groupBy("query_id").agg(ordered_join(F.collect_list(F.struct("rank", "text")), "\n").alias("text"))
    whole = chunks.join(good.select("query_id"), "query_id", "left_anti").groupBy("query_id").agg(ordered_join(F.collect_list(F.struct("rank", "text")), "\n").alias("text"))
    return good.union(whole)


def compressed(chunks: DataFrame, least: float = 0.2) -> DataFrame:
    """Each chunk (query_id, query, item_id, text) cut to the sentences that share at least `least` of the query's words; emptied ones drop."""
    q = F.array_distinct(tokens(F.col("query")))
    share = lambda x: F.size(F.array_intersect(q, tokens(x))) / F.greatest(F.size(q), F.lit(1))
    keep = F.array_join(F.filter(sentences(F.col("text")), lambda x: share(x) >= least), " ")
    return chunks.select("query_id", "item_id", F.length("text").cast("long").alias("before"), keep.alias("text")).where("text <> ''").withColumn("after", F.length("text").cast("long"))


def context(chunks: DataFrame, separator: str = "\n\n---\n\n", empty: str = "(no context available)") -> DataFrame:
    """(query_id, context): the texts of (query_id, rank, text) in order of rank."""
    return chunks.groupBy("query_id").agg(ordered_join(F.filter(F.collect_list(F.struct("rank", "text")), lambda x: x["text"].isNotNull()), separator, empty).alias("context"))


def grounded(answer: Column, source: Column, least: float = 0.5) -> Column:
    """The offline entailment rule: at least `least` of the answer's distinct words are in the source."""
    a = F.array_distinct(tokens(answer))
    return F.when(F.coalesce(F.length(source), F.lit(0)) == 0, F.lit(False)).otherwise(F.size(F.array_intersect(a, tokens(source))) >= least * F.size(a))


def attempts(answers: DataFrame, most: int = 2) -> DataFrame:
    """Self-grading: of (query_id, attempt, answer, source, question) the first grounded and useful attempt, at most `most` looked at.

    (query_id, attempts, final_answer, status); no good attempt gives an empty answer.
    """
    useful = F.size(F.array_intersect(tokens(F.col("answer")), tokens(F.col("question")))) > 0
    rated = answers.where(F.col("attempt") <= most).withColumn("grounded", grounded(F.col("answer"), F.col("source"))).withColumn("useful", useful)
    good = F.col("grounded") & F.col("useful")
    first = F.min(F.when(good, F.col("attempt"))).over(Window.partitionBy("query_id"))
    looked = rated.withColumn("first", first).where(F.col("first").isNull() | (F.col("attempt") <= F.col("first")))
    trace = F.array_sort(F.collect_list(F.struct("attempt", "answer", "grounded", "useful")))
    final = F.max(F.when(good & (F.col("attempt") == F.col("first")), F.col("answer")))
    return looked.groupBy("query_id").agg(trace.alias("attempts"), F.coalesce(final, F.lit("")).alias("final_answer"), F.when(final.isNull(), "no grounded answer").otherwise("answered").alias("status"))


def extracted_triples(output: Column) -> Column:
    """(s, r, o) structs of the three-field lines of <triples>...</triples>; NONE gives none."""
    lines = F.split(F.trim(tagged(output, "triples")), "\n")
    fields = F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda y: F.trim(y)))
    whole = F.filter(fields, lambda f: (F.size(f) == 3) & F.forall(f, lambda y: y != ""))
    return F.transform(whole, lambda f: F.struct(f[0].alias("s"), f[1].alias("r"), f[2].alias("o")))

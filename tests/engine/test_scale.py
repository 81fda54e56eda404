"""Results that only larger tables show, against SQL or a plain version."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fathom.functions.text import stripped
from fathom.operators import chunk, generation, lexical
from fathom.plans import registry
from tests.engine.test_oracle import plain

duckdb = pytest.importorskip("duckdb")


def compare(spark, folder, name, **tables):
    """The query and its SQL over the tables given (rows, Spark schema): both as sorted text."""
    c = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    mine, theirs = registry.queries()[name](spark, str(folder)).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    return [sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)) for df in (mine, theirs)]


def test_l2_normalize_keeps_the_sign_of_zero(spark, tmp_path):
    rows = [(1, [1.0, -1e-7, 1e-7, -0.5], 0), (2, [-3.0, 4.0, -0.0, -1e-9], 1), (3, None, 1)]
    mine, theirs = compare(spark, tmp_path, "l2_normalize", embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    assert mine == theirs and any("-0," in str(r) for r in mine)


def plain_meteor(candidate, reference):
    """The same rule by comparing every pair of words."""
    c, r = candidate.lower().split(), reference.lower().split()
    used, pairs = set(), []
    for same in (lambda a, b: a == b, lambda a, b: generation.stem(a) == generation.stem(b)):
        for i, w in enumerate(c):
            if all(i != p[0] for p in pairs):
                j = next((j for j, v in enumerate(r) if j not in used and same(w, v)), None)
                if j is not None:
                    used.add(j)
                    pairs.append((i, j))
    if not pairs:
        return 0.0
    pairs.sort()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:], strict=False))
    p, q, m = len(pairs) / len(c), len(pairs) / len(r), len(pairs)
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


def test_meteor_matches_words_without_comparing_pairs():
    rng = random.Random(5)
    words = "run runs running Run ran hope hoping hoped hop a the cats cat relational relate".split()
    for _ in range(400):
        c, r = (" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(2))
        assert generation.meteor(c, r) == plain_meteor(c, r)
    began = time.process_time()
    assert generation.meteor(" ".join(f"a{i}ing" for i in range(3000)), " ".join(f"b{i}ed" for i in range(3000))) == 0
    assert time.process_time() - began < 5  # 9 million pairs of stems take minutes


def best_by_pairs(spark, items, queries, k, ids):
    pairs = lexical.bm25(items.select(F.struct(*ids).alias("item_id"), "text"), queries).collect()
    out = []
    for q in {r["query_id"] for r in pairs}:
        mine = sorted((-r["score"], tuple(r["item_id"])) for r in pairs if r["query_id"] == q)[:k]
        out += [(q, *i, -s, n) for n, (s, i) in enumerate(mine, 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [10**6, 0])
def test_bm25_top_is_the_best_of_all_pairs(spark, monkeypatch, most):
    """Equal texts over several tasks, blocks of a few tokens and queries, unknown words, empty texts; above and below the terms' limit."""
    monkeypatch.setattr(lexical, "MOST_TERMS", most)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    rng = random.Random(9)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    rows = [(i, rng.randrange(-2, 1500), " ".join(word() for _ in range(rng.randrange(9)))) for i in range(600)]
    asked = [(q, " ".join(word() for _ in range(q % 7 + 1)) + (" absent" if q % 2 else "")) for q in range(11)]
    items = spark.createDataFrame(rows, "doc_id long, pos long, text string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    found = lexical.bm25_top(items, queries, 4, ("pos", "doc_id"))
    assert sorted(tuple(r) for r in found.select("query_id", "pos", "doc_id", "score", "rank").collect()) == best_by_pairs(spark, items, queries, 4, ("pos", "doc_id"))


def test_chunk_rankings_shuffle_no_pairs(spark):
    """The shuffle of a chunk ranking holds k rows a query and task, not the pairs of queries and chunks with a common token."""
    items = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("the w"), F.col("id") % 7).alias("text"))
    queries = spark.createDataFrame([(q, f"the w{q}") for q in range(5)], "query_id long, text string")
    plan = lexical.bm25_top(items, queries, 3, ("doc_id", "pos"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_stripped_and_windows(spark):
    """White space of every kind at the ends, alone, inside; windows over several runs, with characters of up to four bytes."""
    texts = [chr(i) + "a" + chr(i) + "b" + chr(i) * 2 for i in range(1, 0x3100)] + ["", " \n\u3000", None, "x\r\n\n", "\U0001f600 "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(~stripped(F.col("text")).eqNullSafe(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))).count() == 0
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("ab \u00e9\u3042\U0001f600") for _ in range(n))) for i, n in enumerate([0, 1, 6, 7, 8, 95, 96, 97, 98, 111, 112, 113, 500])]
    for pure in (True, False):
        got = chunk.windows(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", 8, 2, pure_tail=pure, strip=False).select("doc_id", "pos", "start", "text").collect()
        want = [(i, n, s, t[s : s + 8]) for i, t in docs if t for n, s in enumerate(range(0, max(1, len(t) if pure else len(t) - 2), 6))]
        assert sorted(map(tuple, got)) == want

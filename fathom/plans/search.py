"""Queries of vector search, lexical search, fusion and retrieval metrics, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import vectors as V
from fathom.operators import chunk, fuse, lexical, metrics, retrieve, vector
from fathom.plans.chunking import _GROUPS, windows_sql
from fathom.plans.chunking import SQL as CHUNKS_SQL
from fathom.sources.index_store import stored
from fathom.sources.tables import table, vector_queries, vectors

K = 5


def _docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("text").alias("keyword"))


def _filtered(condition):
    return lambda s, d: vector.top_k(vectors(s, d).where(condition), vector_queries(s, d), K)


def _centres(s, d):
    return vector.centroids(vectors(s, d), "label").withColumnRenamed("label", "cell")


def _lists(s, d):
    """Two lists per vector query: by cosine (0) and by negated distance over the first 16 dimensions (1)."""
    cut = lambda df, c: df.withColumn(c, V.truncated(F.col(c), 16))
    full = vector.top_k(vectors(s, d), vector_queries(s, d), 10).withColumn("list_id", F.lit(0))
    short = vector.top_k(cut(vectors(s, d), "vec"), cut(vector_queries(s, d), "qvec"), 10).withColumn("list_id", F.lit(1))
    return full.union(short)


def _bm25(s, d):
    return lexical.bm25(_docs(s, d), _asked(s, d))


def _bm25_topk(s, d):
    return vector.ranked(_bm25(s, d), K)


def _hybrid(s, d):
    # the dense side: hashed word vectors are scored as sparse vectors
    fused = fuse.rrf_of_full_ranks([_bm25(s, d), _sparse(s, d)], _docs(s, d), _asked(s, d), K)
    return vector.ranked(fused, K).select("query_id", "item_id", "score", "rank")


def _weights(items, name, w):
    split = items.select(name, F.explode(F.split(F.lower("text"), " ")).alias("token")).where("token <> ''")
    return split.groupBy(name, "token").agg(F.count(F.lit(1)).alias(w))


def _sparse(s, d):
    return vector.sparse_dot(_weights(_docs(s, d), "item_id", "w"), _weights(_asked(s, d), "query_id", "qw")).withColumn("score", F.col("score").cast("double"))


def _variants(s, d):
    """Each benchmark text as it is (0), its first half (1) and its second half (2) by words."""
    words = _asked(s, d).withColumn("w", F.split("text", " "))
    half = F.ceil(F.size("w") / 2).cast("int")
    text = F.array("text", F.array_join(F.slice("w", 1, half), " "), F.array_join(F.slice("w", half + 1, F.greatest(F.lit(0), F.size("w") - half)), " "))
    return words.select("query_id", F.posexplode(text).alias("list_id", "text")).select((F.col("query_id") * 10 + F.col("list_id")).alias("query_id"), "text")


def _multi(s, d):
    hits = vector.ranked(lexical.bm25(_docs(s, d), _variants(s, d)), 10)
    return hits.select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), (F.col("query_id") % 10).alias("list_id"), "item_id", "score", "rank")


def _qrels(s, d):
    return retrieve.keyword_relevance(_docs(s, d), _asked(s, d))


def _label_rel(s, d):
    return vectors(s, d).join(vector_queries(s, d), F.col("label") == F.col("qlabel")).where("item_id <> query_id").select("query_id", "item_id")


def _label_metrics(s, d):
    found = vector.top_k(vectors(s, d), vector_queries(s, d), 10, skip_self=True)
    rows = metrics.per_query(vector_queries(s, d), found, _label_rel(s, d), 10)
    return rows.select("query_id", *[F.round(m, 6).alias(m) for m in metrics.METRICS])


def _strategies(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    asked, qrels = _asked(s, d), stored(_qrels(s, d))
    made = {"fixed": chunk.CHUNKERS["fixed"](docs, "doc_id"), "sentence": chunk.CHUNKERS["sentence"](docs, "doc_id")}
    hits = reduce(lambda a, b: a.union(b), [lexical.bm25_top(rows, asked, 10, ("doc_id", "pos")).withColumn("strategy", F.lit(name)) for name, rows in made.items()])
    by_doc = stored(hits.groupBy("strategy", "query_id", "doc_id").agg(F.min("rank").alias("at")))
    order = Window.partitionBy("strategy", "query_id").orderBy("at", "doc_id")
    first = by_doc.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("strategy", "query_id", F.col("doc_id").alias("item_id"), "rank")
    each = [metrics.means(metrics.per_query(asked, first.where(F.col("strategy") == name), qrels, 3, 5)).withColumn("strategy", F.lit(name)) for name in made]
    return reduce(lambda a, b: a.union(b), each)


def strategy_compare(s, d):
    """The flagship: chunkers compared by the retrieval quality that BM25 over their chunks reaches."""
    return _strategies(s, d)


def _keyword_hit(across):
    def run(s, d):
        asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").withColumn("keyword", F.element_at(F.split("text", " "), 3))
        hits = vector.ranked(lexical.bm25(_docs(s, d), asked), 3)
        return metrics.keyword_hits(hits, _docs(s, d), asked, 3, across=across)

    return run


def _mmr(s, d):
    pool = vector.top_k(vectors(s, d), vector_queries(s, d), 15)
    return vector.diverse(pool, vectors(s, d), 3)


def _maxsim(s, d):
    """Each vector as eight parts of eight numbers."""
    return vector.top_k(vectors(s, d), vector_queries(s, d), K, "max_sim", width=8).withColumn("score", F.round("score", 6))


def _probe(n):
    return lambda s, d: vector.probe(vectors(s, d), vector_queries(s, d), _centres(s, d), n, K)


def _int8(s, d):
    return vector.quantised(vectors(s, d)).select("item_id", F.transform("code", lambda x: x.cast("long")).alias("code"))


def _code_recall(s, d):
    """How many of the exact ten nearest the coded vectors find, by coding."""
    items = vectors(s, d)
    exact = vector.top_k(items, vector_queries(s, d), 10).select("query_id", "item_id")
    out = []
    for name, coded in (("int8", vector.quantised(items)), ("sign", vector.signs(items))):
        coded = coded.select("item_id", F.col("code").alias("vec"))
        asked = coded.where(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.col("vec").alias("qvec"))
        hits = vector.top_k(coded, asked, 10).join(exact, ["query_id", "item_id"], "left_semi")
        out.append(hits.agg(F.count(F.lit(1)).alias("n_found")).select(F.lit(name).alias("coding"), "n_found"))
    return out[0].union(out[1])


def _matryoshka(s, d):
    out = []
    for dims in (64, 32, 16, 8):
        items = vectors(s, d).withColumn("vec", V.truncated(F.col("vec"), dims))
        asked = vector_queries(s, d).withColumn("qvec", V.truncated(F.col("qvec"), dims))
        hits = vector.top_k(items, asked, 10, skip_self=True).join(_label_rel(s, d), ["query_id", "item_id"], "left_semi")
        out.append(hits.agg(F.count(F.lit(1)).alias("n_same_label")).crossJoin(vector.storage_kb(items, 4)).select(F.lit(dims).cast("long").alias("dims"), "n_same_label", F.round("kb", 4).alias("kb")))
    return reduce(lambda a, b: a.union(b), out)


def _floor_gated(s, d):
    kept = fuse.admitted(_lists(s, d), {1: 0.55})
    return vector.ranked(fuse.rrf(kept), K).select("query_id", "item_id", "score", "rank")


def _questions(s, d):
    """Hypothetical questions: every sentence group of a document stands for it."""
    docs = table(s, d, "documents").select("doc_id", "text")
    q = chunk.sentence_groups(docs, "doc_id", 3, 0, 1)
    return retrieve.best_per_group(lexical.bm25_top(q, _asked(s, d), 15, ("doc_id", "pos")), "doc_id", K)


def _parents(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    hits = lexical.bm25_top(chunk.small_to_big(docs, "doc_id"), _asked(s, d), 15, ("doc_id", "parent_pos", "pos"))
    return retrieve.best_per_group(hits.withColumn("parent", F.col("doc_id") * 1000 + F.col("parent_pos")), "parent", K)


def _unified(s, d):
    """Two kinds in one ranking: even ids are texts, odd ones images."""
    hits = vector.top_k(vectors(s, d), vector_queries(s, d), K)
    return hits.withColumn("kind", F.when(F.col("item_id") % 2 == 0, "text").otherwise("image"))


def _raptor(s, d):
    """Leaves and cluster summaries (ids -1 - label) searched together."""
    items = vectors(s, d)
    summaries = vector.centroids(items, "label").select((-1 - F.col("label").cast("long")).alias("item_id"), F.col("centroid").alias("vec"))
    both = items.select("item_id", F.col("vec").cast("array<double>").alias("vec")).union(summaries)
    return vector.top_k(both, vector_queries(s, d), K).withColumn("kind", F.when(F.col("item_id") < 0, "summary").otherwise("leaf"))


def _self_query(s, d):
    asked = s.createDataFrame([(0, '```json{"semantic_query": "x", "filters": {"label": "3"}}```'), (100, '{"semantic_query": "y", "filters": {"colour": "red"}}'), (200, '{"semantic_query": "z", "filters": {}}')], "query_id long, answer string")
    parsed = asked.withColumn("j", F.from_json(F.regexp_replace("answer", "^`*(json)?|`*$", ""), "semantic_query string, filters map<string,string>"))
    known = F.array_except(F.map_keys("j.filters"), F.array(F.lit("label")))
    plan = parsed.where(F.size(known) == 0).select("query_id", F.col("j.filters")["label"].alias("wanted"))
    asked = vector_queries(s, d).join(plan, "query_id")
    items = vectors(s, d)
    pairs = items.join(asked, F.col("wanted").isNull() | (F.col("label").cast("string") == F.col("wanted")))  # three literal queries
    return vector.ranked(pairs.select("query_id", "item_id", F.round(V.cosine(F.col("qvec"), F.col("vec")), 9).alias("score")), K)


def _hops(s, d):
    def search(q):
        return vector.ranked(lexical.bm25(_docs(s, d), q), 2)

    def follow(q, new):
        first = new.where("rank = 1").join(_docs(s, d), "item_id")
        return first.select("query_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("text"))

    return retrieve.hops(_asked(s, d).select("query_id", "text"), search, follow)


QUERIES = {
    "topk_dot": lambda s, d: vector.top_k(vectors(s, d), vector_queries(s, d), K, "dot"),
    "topk_cosine": lambda s, d: vector.top_k(vectors(s, d), vector_queries(s, d), K),
    "topk_distance": lambda s, d: vector.top_k(vectors(s, d), vector_queries(s, d), K).select("query_id", "item_id", "rank", F.round(1 - F.col("score"), 9).alias("distance")),
    "topk_filtered_eq": _filtered("label = 3"),
    "topk_filtered_in": _filtered("label IN (2, 5)"),
    "topk_filtered_range": _filtered("label <= 4"),
    "topk_filtered_between": _filtered("label BETWEEN 6 AND 8"),
    "topk_filtered_expr": _filtered("label >= 7 AND label <= 9"),
    "topk_filtered_idset": lambda s, d: vector.top_k(vectors(s, d).join(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi"), vector_queries(s, d), K),
    "filter_unknown_key": lambda s, d: vector.matching(vectors(s, d), {"label": 1, "colour": "red"}).groupBy().count().select(F.col("count").alias("n")),
    "l2_normalize": lambda s, d: vectors(s, d).select("item_id", F.transform(V.normalised(F.col("vec")), lambda x: V.rounded(x, 6)).alias("unit")),
    "centroids": lambda s, d: vector.centroids(vectors(s, d), "label").select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid")),
    "matryoshka": _matryoshka,
    "quantize_int8": _int8,
    "quantize_binary": lambda s, d: vector.signs(vectors(s, d)).select("item_id", F.transform("code", lambda x: x.cast("long")).alias("code")),
    "quantized_recall": _code_recall,
    "storage_kb": lambda s, d: vector.storage_kb(vectors(s, d), 4).select(F.round("kb", 4).alias("kb")),
    "ivf_probe1": _probe(1),
    "ivf_exhaustive": _probe(10),
    "ivf_kmeans": lambda s, d: vector.probe(vectors(s, d), vector_queries(s, d), vector.k_means_cells(vectors(s, d), 8), 8, K),
    "mmr": _mmr,
    "maxsim": _maxsim,
    "sparse_dot": lambda s, d: vector.ranked(_sparse(s, d), K),
    "bm25_topk": _bm25_topk,
    "bm25_full_ranks": lambda s, d: lexical.full_ranks(_bm25(s, d), _docs(s, d), _asked(s, d), 10),
    "hybrid_rrf": _hybrid,
    "rrf": lambda s, d: vector.ranked(fuse.rrf(_lists(s, d)), K),
    "rrf_of_scores": lambda s, d: vector.ranked(fuse.rrf_of_scores(_lists(s, d).where("list_id = 0"), _lists(s, d).where("list_id = 1")), K),
    "rrf_by_text": lambda s, d: vector.ranked(fuse.rrf_by_text(vector.ranked(_bm25(s, d), 10).withColumn("list_id", F.lit(0)), _docs(s, d)), K),
    "multi_query_rrf": lambda s, d: vector.ranked(fuse.rrf(_multi(s, d)), K),
    "rrf_floor_gated": _floor_gated,
    "ordered_union": lambda s, d: fuse.ordered_union(_multi(s, d), 5),
    "budgeted_union": lambda s, d: fuse.budgeted_union(_multi(s, d), 6),
    "hypothetical_q_dedupe": _questions,
    "parent_expand": _parents,
    "hierarchical": lambda s, d: retrieve.two_level(vectors(s, d).withColumnRenamed("label", "section"), vector_queries(s, d), "section", _centres(s, d), 3).select("query_id", F.col("section").cast("long").alias("section"), "item_id", "score", "rank"),
    "unified_modal": _unified,
    "raptor_flat": _raptor,
    "self_query": _self_query,
    "iterative_hops": _hops,
    "qrels_keyword": _qrels,
    "retrieval_metrics": _label_metrics,
    "retrieval_metrics_mean": lambda s, d: metrics.means(_label_metrics(s, d)),
    "keyword_hit_any": _keyword_hit(False),
    "keyword_hit_concat": _keyword_hit(True),
    "strategy_compare": strategy_compare,
}

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = lambda a, b: f"({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)}) + 1e-8))"
_V = "v AS (SELECT vec_id AS item_id, embedding AS vec, label FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS qvec, label AS qlabel FROM embeddings WHERE vec_id % 100 = 0)"
_RANK = lambda scored, k, cols="query_id, item_id, score": f"SELECT {cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({scored})) WHERE rank <= {k}"
_SCORED = lambda metric=_COS("qvec", "vec"), where="TRUE": f"SELECT query_id, item_id, label, round({metric}, 9) AS score FROM v, q WHERE {where}"
_TOP = lambda k=K, metric=_COS("qvec", "vec"), where="TRUE": f"WITH {_V} " + _RANK(_SCORED(metric, where), k)
_TOK = r"list_filter(string_split(regexp_replace(lower({0}), '\s+', ' ', 'g'), ' '), lambda t: t <> '')"


def bm25_sql(items: str, queries: str, name: str = "b") -> str:
    """CTEs ending in {name}(query_id, item_id, score)."""
    return f"""
 {name}_i AS MATERIALIZED ({items}), {name}_q AS MATERIALIZED ({queries}),
 {name}_x AS MATERIALIZED (SELECT item_id, w, len(w) AS dl FROM (SELECT item_id, {_TOK.format('text')} AS w FROM {name}_i)),
 {name}_p AS MATERIALIZED (SELECT item_id, dl, token, count(*) AS tf FROM (SELECT item_id, dl, unnest(w) AS token FROM {name}_x) GROUP BY ALL),
 {name}_s AS MATERIALIZED (SELECT count(*) AS n_items, avg(dl) AS avgdl FROM {name}_x),
 {name}_r AS MATERIALIZED (SELECT token, ln(n_items - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT token, count(*) AS df FROM {name}_p GROUP BY token), {name}_s),
 {name}_w AS MATERIALIZED (SELECT token, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {name}_r) ELSE raw END AS idf FROM {name}_r),
 {name}_t AS MATERIALIZED (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format('text')}) AS token FROM {name}_q) GROUP BY ALL),
 {name} AS MATERIALIZED (SELECT query_id, item_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
   FROM {name}_p JOIN {name}_w USING (token) JOIN {name}_t USING (token), {name}_s GROUP BY query_id, item_id)"""


_ITEMS, _ASKED = "SELECT doc_id AS item_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark"
_BM = bm25_sql(_ITEMS, _ASKED)
_WT = lambda key, src, w: f"SELECT {key}, token, count(*) AS {w} FROM (SELECT {key}, unnest(string_split(lower(text), ' ')) AS token FROM ({src})) WHERE token <> '' GROUP BY ALL"
_SP = f"sp AS (SELECT query_id, item_id, sum(w * qw)::DOUBLE AS score FROM ({_WT('item_id', _ITEMS, 'w')}) JOIN ({_WT('query_id', _ASKED, 'qw')}) USING (token) GROUP BY query_id, item_id)"
_RRF = lambda lists, k=K: _RANK(f"SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({lists}) GROUP BY query_id, item_id", k)
_ALL_RANKS = lambda scored: f"""SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT q.item_id AS query_id, d.doc_id AS item_id, greatest(coalesce(score, 0), 0)::DOUBLE AS score
        FROM benchmark q CROSS JOIN documents d LEFT JOIN {scored} s ON s.query_id = q.item_id AND s.item_id = d.doc_id)"""  # noqa: E731
_SHORT = _COS("qvec[1:16]", "vec[1:16]")
_LISTS = f"SELECT 0 AS list_id, * FROM ({_RANK(_SCORED(), 10)}) UNION ALL SELECT 1, * FROM ({_RANK(_SCORED(_SHORT), 10)})"
_VARIANTS = """SELECT item_id * 10 + i AS query_id, CASE i WHEN 0 THEN text WHEN 1 THEN array_to_string(w[1:h], ' ') ELSE array_to_string(w[h + 1:], ' ') END AS text
  FROM (SELECT item_id, text, string_split(text, ' ') AS w, ceil(len(string_split(text, ' ')) / 2)::INT AS h FROM benchmark), (SELECT unnest([0, 1, 2]) AS i)"""
_MULTI_CTE = bm25_sql(_ITEMS, _VARIANTS, "m")
_MULTI = f"SELECT (query_id // 10)::BIGINT AS query_id, query_id % 10 AS list_id, item_id, score, rank FROM ({_RANK('SELECT * FROM m', 10)})"
_FIRST = "SELECT query_id, item_id, min((list_id, rank)) AS seen FROM ({0}) GROUP BY query_id, item_id"
_UNION = lambda lists, where: f"SELECT query_id, item_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, item_id) AS pos FROM ({_FIRST.format(lists)})) WHERE {where}"
_REL = "rel AS (SELECT query_id, item_id FROM v, q WHERE label = qlabel AND item_id <> query_id)"
_QRELS = "SELECT b.item_id AS query_id, d.doc_id AS item_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))"


def metrics_sql(queries: str, ranked: str, relevant: str, k: int, depth: int) -> str:
    return f"""SELECT query_id, coalesce(n, 0) / {k}::DOUBLE AS precision, CASE WHEN n_rel > 0 THEN coalesce(n, 0) / n_rel::DOUBLE ELSE 0 END AS recall, coalesce(1.0::DOUBLE / f, 0) AS mrr,
      CASE WHEN n_rel > 0 THEN coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 100) t(i) WHERE i <= least(n_rel, {k})) ELSE 0 END AS ndcg, CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit
      FROM ({queries}) LEFT JOIN (SELECT query_id, count(DISTINCT item_id) AS n_rel FROM ({relevant}) GROUP BY 1) USING (query_id)
      LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= {k}) AS n, min(rank) AS f, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
        FROM ({ranked}) SEMI JOIN (SELECT DISTINCT query_id, item_id FROM ({relevant})) USING (query_id, item_id) WHERE rank <= {depth} GROUP BY 1) USING (query_id)"""


_MEANS = "count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)
_LABEL = metrics_sql("SELECT query_id FROM q", _RANK(_SCORED(where="item_id <> query_id"), 10), "SELECT * FROM rel", 10, 10)
_GROUP = lambda hits, key: f"""SELECT query_id, {key} AS item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, {key}) AS rank
   FROM (SELECT query_id, {key}, min(rank) AS seen, max(score) AS score FROM ({hits}) GROUP BY query_id, {key})) WHERE rank <= 5"""  # noqa: E731
_CELLS = "cen AS (SELECT label AS cell, list(m ORDER BY dim) AS centroid FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS dim FROM v) GROUP BY label, dim) GROUP BY label)"
_NEAR = lambda rows, vec, n: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {'item_id' if vec == 'vec' else 'query_id'} ORDER BY round({_COS(vec, 'centroid')}, 9) DESC, cell) AS nth FROM {rows}, cen) WHERE nth <= {n}"
_PROBE = lambda n: f"WITH {_V}, {_CELLS}, fv AS ({_NEAR('v', 'vec', 1)}), fq AS ({_NEAR('q', 'qvec', n)}) " + _RANK(f"SELECT query_id, item_id, round({_COS('qvec', 'vec')}, 9) AS score FROM fv JOIN fq USING (cell)", K)
_INT8 = """SELECT item_id, list(c ORDER BY dim) AS code FROM (SELECT item_id, dim, (CASE WHEN hi > lo THEN floor((x - lo) / ((hi - lo) / 255) + 0.5::DOUBLE) ELSE 0 END - 128)::BIGINT AS c
  FROM (SELECT item_id, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS dim FROM v) JOIN (SELECT dim, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS dim FROM v) GROUP BY dim) USING (dim)) GROUP BY item_id"""
_SIGN = "SELECT item_id, list_transform(range(0, 64, 8), lambda i: (list_sum(list_transform(range(0, 8), lambda j: CASE WHEN vec[i + j + 1] > 0 THEN 1 << (7 - j) ELSE 0 END)) - 128)::BIGINT) AS code FROM v"
_CODED = lambda name, src: f"SELECT '{name}' AS coding, count(*) AS n_found FROM ({_RANK(f'SELECT a.item_id AS query_id, b.item_id, round({_COS("a.code", "b.code")}, 9) AS score FROM ({src}) a, ({src}) b WHERE a.item_id % 100 = 0', 10)}) SEMI JOIN ({_RANK(_SCORED(), 10)}) USING (query_id, item_id)"
_MAT = lambda n: f"SELECT {n}::BIGINT AS dims, (SELECT count(*) FROM ({_RANK(_SCORED(_COS(f'qvec[1:{n}]', f'vec[1:{n}]'), 'item_id <> query_id'), 10)}) SEMI JOIN rel USING (query_id, item_id)) AS n_same_label, round((SELECT sum(len(vec[1:{n}])) FROM v) * 4.0::DOUBLE / 1024, 4) AS kb"
_MMR = f"""WITH {_V}, p AS ({_RANK(_SCORED(), 15)}), pv AS (SELECT p.query_id, p.item_id, p.score, v.vec FROM p JOIN v USING (item_id)),
 a AS (SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) = 1),
 g2 AS (SELECT pv.*, round({_COS('pv.vec', 'a.vec')}, 9) AS near FROM pv JOIN a USING (query_id) WHERE pv.item_id <> a.item_id),
 b AS (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.5::DOUBLE * score - 0.5::DOUBLE * near, 9) DESC, item_id) = 1),
 g3 AS (SELECT g2.query_id, g2.item_id, g2.score, greatest(g2.near, round({_COS('g2.vec', 'b.vec')}, 9)) AS near FROM g2 JOIN b USING (query_id) WHERE g2.item_id <> b.item_id),
 c AS (SELECT * FROM g3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.5::DOUBLE * score - 0.5::DOUBLE * near, 9) DESC, item_id) = 1)
 SELECT query_id, item_id, 1::BIGINT AS pick FROM a UNION ALL SELECT query_id, item_id, 2 FROM b UNION ALL SELECT query_id, item_id, 3 FROM c"""
_PART = "list_transform(range(0, 64, 8), lambda i: {0}[i + 1:i + 8])"
_MAXSIM = f"list_sum(list_transform({_PART.format('qvec')}, lambda t: list_max(list_transform({_PART.format('vec')}, lambda u: list_sum(list_transform(list_zip(t, u), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))))))"
_HITQ = "SELECT item_id AS query_id, text, string_split(text, ' ')[3] AS keyword FROM benchmark"
_HITS = f"WITH {bm25_sql(_ITEMS, _HITQ)}, h AS ({_RANK('SELECT * FROM b', 3)}), t AS (SELECT h.query_id, h.rank, d.text, k.keyword FROM h JOIN documents d ON d.doc_id = h.item_id JOIN ({_HITQ}) k ON k.query_id = h.query_id)"


def _strategy_sql() -> str:
    ctes, parts = [], []
    for i, (name, rows) in enumerate((("fixed", windows_sql(400, 50, 40)), ("sentence", _GROUPS(5, 1)))):
        ctes.append(bm25_sql(f"SELECT doc_id * 100000 + pos AS item_id, text FROM ({rows})", _ASKED, f"s{i}"))
        hits = f"SELECT *, (item_id // 100000)::BIGINT AS doc_id FROM ({_RANK(f'SELECT * FROM s{i}', 10)})"
        parts.append(f"SELECT {_MEANS}, '{name}' AS strategy FROM ({metrics_sql('SELECT item_id AS query_id FROM benchmark', _GROUP(hits, 'doc_id'), _QRELS, 3, 5)})")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def _grouped_sql(rows: str, key: str, divide: int) -> str:
    hits = f"SELECT *, (item_id // {divide})::BIGINT AS {key} FROM ({_RANK('SELECT * FROM b', 15)})"
    return f"WITH {bm25_sql(rows, _ASKED)} {_GROUP(hits, key)}"


def _hops_sql() -> str:
    first = "SELECT x.query_id, array_to_string(string_split(d.text, ' ')[1:8], ' ') AS text FROM ({0}) x JOIN documents d ON d.doc_id = x.item_id WHERE x.rank = 1"
    ctes = [bm25_sql(_ITEMS, _ASKED, "x1"), f"h1 AS (SELECT query_id, item_id, 1::BIGINT AS hop, rank FROM ({_RANK('SELECT * FROM x1', 2)}))"]
    seen = "SELECT query_id, item_id FROM h1"
    for i in (2, 3):
        ctes.append(bm25_sql(_ITEMS, first.format(f"SELECT * FROM h{i - 1}"), f"x{i}"))
        ctes.append(f"h{i} AS (SELECT query_id, item_id, {i}::BIGINT AS hop, rank FROM ({_RANK(f'SELECT * FROM x{i}', 2)}) ANTI JOIN ({seen}) USING (query_id, item_id))")
        seen += f" UNION ALL SELECT query_id, item_id FROM h{i}"
    return f"WITH {', '.join(ctes)} SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3"


SQL = {
    "topk_dot": _TOP(metric=_DOT.format("qvec", "vec")),
    "topk_cosine": _TOP(),
    "topk_distance": f"SELECT query_id, item_id, rank, round(1 - score, 9) AS distance FROM ({_TOP()})",
    "topk_filtered_eq": _TOP(where="label = 3"),
    "topk_filtered_in": _TOP(where="label IN (2, 5)"),
    "topk_filtered_range": _TOP(where="label <= 4"),
    "topk_filtered_between": _TOP(where="label BETWEEN 6 AND 8"),
    "topk_filtered_expr": _TOP(where="label >= 7 AND label <= 9"),
    "topk_filtered_idset": _TOP(where="item_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "filter_unknown_key": "SELECT 0::BIGINT AS n",
    "l2_normalize": f"WITH {_V} SELECT item_id, list_transform(vec, lambda x: round(x::DOUBLE / sqrt({_DOT.format('vec', 'vec')}), 6)) AS unit FROM v",
    "centroids": f"WITH {_V}, {_CELLS} SELECT cell AS label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM cen",
    "matryoshka": f"WITH {_V}, {_REL} {' UNION ALL '.join(_MAT(n) for n in (64, 32, 16, 8))}",
    "quantize_int8": f"WITH {_V} {_INT8}",
    "quantize_binary": f"WITH {_V} {_SIGN}",
    "quantized_recall": f"WITH {_V} {_CODED('int8', _INT8)} UNION ALL {_CODED('sign', _SIGN)}",
    "storage_kb": f"WITH {_V} SELECT round(sum(len(vec)) * 4.0::DOUBLE / 1024, 4) AS kb FROM v",
    "ivf_probe1": _PROBE(1),
    "ivf_exhaustive": _TOP(),
    "ivf_kmeans": _TOP(),
    "mmr": _MMR,
    "maxsim": f"WITH {_V} " + _RANK(f"SELECT query_id, item_id, round({_MAXSIM}, 6) AS score FROM v, q", K),
    "sparse_dot": f"WITH {_SP} {_RANK('SELECT * FROM sp', K)}",
    "bm25_topk": f"WITH {_BM} {_RANK('SELECT * FROM b', K)}",
    "bm25_full_ranks": f"WITH {_BM} {_RANK('SELECT q.item_id AS query_id, d.doc_id AS item_id, greatest(coalesce(score, 0), 0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN b ON b.query_id = q.item_id AND b.item_id = d.doc_id', 10)}",
    "hybrid_rrf": f"WITH {_BM}, {_SP} " + _RRF(f"{_ALL_RANKS('b')} UNION ALL {_ALL_RANKS('sp')}"),
    "rrf": f"WITH {_V} {_RRF(_LISTS)}",
    "rrf_of_scores": f"WITH {_V} {_RRF(_LISTS)}",
    "rrf_by_text": f"WITH {_BM} " + _RRF(f"SELECT query_id, min(e.doc_id) OVER (PARTITION BY query_id, h.item_id) AS item_id, rank FROM ({_RANK('SELECT * FROM b', 10)}) h JOIN documents d ON d.doc_id = h.item_id JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text) e ON e.text = d.text"),
    "multi_query_rrf": f"WITH {_MULTI_CTE} {_RRF(_MULTI)}",
    "rrf_floor_gated": f"WITH {_V} {_RRF(f'SELECT * FROM ({_LISTS}) WHERE list_id = 0 OR score >= 0.55::DOUBLE')}",
    "ordered_union": f"WITH {_MULTI_CTE} {_UNION(_MULTI, 'pos <= 5')}",
    "budgeted_union": f"WITH {_MULTI_CTE}, l AS ({_MULTI}) {_UNION('SELECT l.* FROM l JOIN (SELECT query_id, count(DISTINCT list_id) AS n FROM l GROUP BY 1) USING (query_id) WHERE rank <= greatest(1, 6 // n)', 'TRUE')}",
    "hypothetical_q_dedupe": _grouped_sql(f"SELECT doc_id * 100000 + pos AS item_id, text FROM ({_GROUPS(3, 0).replace('>= 40', '>= 1')})", "doc_id", 100_000),
    "parent_expand": _grouped_sql(f"SELECT doc_id * 1000000 + parent_pos * 1000 + pos AS item_id, text FROM ({CHUNKS_SQL['chunk_small_to_big']})", "parent", 1000),
    "hierarchical": f"WITH {_V}, {_CELLS}, fq AS ({_NEAR('q', 'qvec', 1)}) SELECT query_id, section, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, label::BIGINT AS section, item_id, round({_COS('qvec', 'vec')}, 9) AS score FROM v JOIN fq ON label = cell)) WHERE rank <= 3",
    "unified_modal": f"SELECT *, CASE WHEN item_id % 2 = 0 THEN 'text' ELSE 'image' END AS kind FROM ({_TOP()})",
    "raptor_flat": f"WITH {_V}, {_CELLS}, u AS (SELECT item_id, vec::DOUBLE[] AS vec FROM v UNION ALL SELECT -1 - cell::BIGINT, centroid FROM cen) SELECT *, CASE WHEN item_id < 0 THEN 'summary' ELSE 'leaf' END AS kind FROM ({_RANK(f'SELECT query_id, item_id, round({_COS("qvec", "vec")}, 9) AS score FROM u, q', K)})",
    "self_query": f"WITH {_V} {_RANK(_SCORED(where='(query_id = 0 AND label = 3) OR query_id = 200'), K)}",
    "iterative_hops": _hops_sql(),
    "qrels_keyword": _QRELS,
    "retrieval_metrics": f"WITH {_V}, {_REL} SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in metrics.METRICS)} FROM ({_LABEL})",
    "retrieval_metrics_mean": f"WITH {_V}, {_REL} SELECT {_MEANS} FROM (SELECT query_id, {', '.join(f'round({m}, 6) AS {m}' for m in metrics.METRICS)} FROM ({_LABEL}))",
    "keyword_hit_any": f"{_HITS} SELECT q.item_id AS query_id, coalesce(bool_or(contains(lower(t.text), lower(t.keyword))), FALSE) AS hit FROM benchmark q LEFT JOIN t ON t.query_id = q.item_id GROUP BY 1",
    "keyword_hit_concat": f"{_HITS} SELECT q.item_id AS query_id, coalesce(contains(lower(string_agg(t.text, ' ' ORDER BY t.rank)), lower(any_value(t.keyword))), FALSE) AS hit FROM benchmark q LEFT JOIN t ON t.query_id = q.item_id GROUP BY 1",
    "strategy_compare": _strategy_sql(),
}

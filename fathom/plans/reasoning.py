"""Queries of routing, grading, graphs, time, state and generation quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions.models import OverlapScorer
from fathom.operators import fuse, generation, grade, graph, lexical, retrieve, state, vector
from fathom.plans.search import _BM, _DOT, _RANK, _TOK, _TOP, _V, _asked, _bm25, _docs
from fathom.sources.tables import table, vector_queries, vectors


def _candidates(s, d, k=5):
    """Each benchmark text's k best documents by BM25: (query_id, query, item_id, rank, text)."""
    hits = vector.ranked(_bm25(s, d), k)
    return hits.join(_docs(s, d), "item_id").join(_asked(s, d).select("query_id", F.col("text").alias("query")), "query_id")


def _routes(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", grade.heuristic_route(F.col("text")).alias("route"))


def _centroid_route(s, d):
    items = vectors(s, d)
    centres = vector.centroids(items, "label").withColumnRenamed("label", "cell")
    return vector.with_cells(items, centres).select("item_id", F.col("label").cast("long").alias("truth"), F.col("cell").cast("long").alias("route"))


def _accuracy(s, d):
    r = _centroid_route(s, d)
    return r.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("route")).cast("double")), 6).alias("accuracy"))


OUTPUTS = ["<scores>7,abc,2</scores>", "<scores>5, 1</scores>", "none", "<scores></scores>", "<scores>3,3,3,3,9</scores>"]
RANKINGS = ["<ranking>3,9,x,3,1</ranking>", "<ranking></ranking>", "no list", "<ranking>4, 2</ranking>"]
TRIPLES = ["<triples>\nA | r | B\nA |  | B\nx | y\n C | s | D \n</triples>", "<triples>NONE</triples>", "nothing", "<triples>P|q|R</triples>"]
LISTED = ["- one\n\n- two \n  three", "", "solo"]


def _literal(s, values, name):
    return s.createDataFrame(list(enumerate(values)), f"id long, {name} string")


def _judge(s, d):
    """Offline evaluator: 1 + 4 * (share of the query's words), down to whole scores, verdict per query."""
    rated = _candidates(s, d).withColumn("score", (F.lit(1) + F.floor(4 * OverlapScorer().score(F.col("query"), F.col("text")))).cast("long"))
    return rated.groupBy("query_id").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n")).select("query_id", "top", "n", grade.verdict(F.array("top")).alias("verdict"))


def _refine(s, d):
    rate = lambda q, x: 1 + F.floor(4 * OverlapScorer().score(x, q))
    return grade.refined(_candidates(s, d), rate)


def _rerank(s, d):
    return retrieve.rerank(vector.ranked(_bm25(s, d), 10), _docs(s, d), _asked(s, d))


def _compress(s, d):
    return grade.compressed(_candidates(s, d, 3), 0.2)


def _ratio(s, d):
    before, after = _candidates(s, d, 3).agg(F.sum(F.length("text")).alias("b")), _compress(s, d).agg(F.sum("after").alias("a"))
    return before.crossJoin(after).select(F.round(1 - F.col("a") / F.col("b"), 6).alias("reduction"))  # one row each


def _stages(s, d):
    """All of a query's first three words present in the naive top 2, the pool of 15, the reranked top 3."""
    words = _asked(s, d).select("query_id", F.slice(F.split(F.lower("text"), " "), 1, 3).alias("keys"))
    pool = vector.ranked(_bm25(s, d), 15)
    final = retrieve.rerank(pool, _docs(s, d), _asked(s, d))
    out = words.select("query_id")
    for name, hits in (("naive", pool.where("rank <= 2")), ("pool", pool), ("final", final)):
        have = hits.join(_docs(s, d), "item_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("t"))
        seen = words.join(have, "query_id", "left").select("query_id", F.forall("keys", lambda k: F.contains(F.coalesce(F.lower("t"), F.lit("")), k)).alias(name))
        out = out.join(seen, "query_id")
    return out


def _self_rag(s, d):
    """Two attempts per query: the first sentence of its best document, then of its second best."""
    c = _candidates(s, d, 2)
    rows = c.select("query_id", F.col("rank").alias("attempt"), F.col("query").alias("question"), F.element_at(F.split("text", r"(?<=[.!?])\s+"), 1).alias("answer"), F.col("text").alias("source"))
    done = grade.attempts(rows)
    return done.select("query_id", F.size("attempts").cast("long").alias("n_attempts"), "final_answer", "status")


def _adaptive(s, d):
    """All queries through one plan table: routed, searched by variant, fused as the route says, reranked."""
    asked = _asked(s, d).select("query_id", "text").withColumn("route", grade.heuristic_route(F.col("text")))
    halves = F.split("text", ", ", 2)
    variants = F.when(F.col("route") == "COMPOUND", halves).when(F.col("route") == "VAGUE", F.array(F.lower("text"))).otherwise(F.array("text"))
    plan = asked.select("query_id", "route", F.posexplode(variants).alias("list_id", "text"))
    hits = vector.ranked(lexical.bm25(_docs(s, d), plan.select((F.col("query_id") * 10 + F.col("list_id")).alias("query_id"), "text")), 15)
    lists = hits.select(F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), (F.col("query_id") % 10).alias("list_id"), "item_id", "rank")
    pool = fuse.budgeted_union(lists, 15, 3).withColumnRenamed("pos", "rank")
    return retrieve.rerank(pool, _docs(s, d), asked).join(asked.select("query_id", "route"), "query_id")


def _edges(s, d):
    """Orders contain parts: a multigraph."""
    return table(s, d, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("relationship"), F.col("l_linenumber").cast("long").alias("source_chunk"))


def _seeds(s, d):
    hits = vector.top_k(vectors(s, d), vector_queries(s, d), 3)
    return hits.select("query_id", F.concat(F.lit("P"), F.col("item_id")).alias("node"))


def _hops(n):
    def run(s, d):
        found = graph.neighbourhood(_edges(s, d), _seeds(s, d), n)
        return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))

    return run


def _geography(s, d):
    """Suppliers in nations in regions."""
    n = table(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("src"), F.concat(F.lit("R"), "n_regionkey").alias("dst"))
    p = table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"))
    return n.union(p).withColumns({"relationship": F.lit("in"), "source_chunk": F.lit(0).cast("long")})


def _regions(s, d):
    return graph.components(_geography(s, d)).select("node", F.col("comp").alias("community"))


def _global(s, d):
    """Each community's partial answer (its summary's number of lines), irrelevant ones dropped, the rest joined."""
    parts = graph.summaries(_geography(s, d), _regions(s, d)).withColumn("answer", F.when(F.size(F.split("summary", "\n")) < 5, F.lit("NOT RELEVANT")).otherwise(F.concat("community", F.lit(": "), F.size(F.split("summary", "\n")).cast("string"))))
    kept = parts.where(~F.contains(F.upper("answer"), F.lit("NOT RELEVANT")))
    return kept.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("answer")), "; "), F.lit("")).alias("answer")).select(F.when(F.col("answer") == "", "no relevant community").otherwise(F.col("answer")).alias("answer"))


def _fold(least, name):
    return lambda s, d: graph.leaders(vectors(s, d).select("item_id"), vector.similar_pairs(vectors(s, d), least)).select("item_id", F.col("leader").alias(name), "sim")


def _cache_rate(s, d):
    r = _fold(0.85, "answered_by")(s, d)
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("item_id") != F.col("answered_by")).cast("double")), 6).alias("hit_rate"))


def _usage(s, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("stage"), "value", k.alias("input_tokens"), (F.col("event_id") % 50).alias("written"), (F.col("event_id") % 1000).alias("read"), (F.col("event_id") % 200).alias("output_tokens"))


def _cost(s, d):
    u = _usage(s, d)
    total = F.sum(state.cost(F.col("input_tokens"), F.col("written"), F.col("read"), F.col("output_tokens")))
    return u.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.avg("input_tokens"), 6).alias("avg_input"), F.round(total, 6).alias("cost"))


def _fresh_cached(s, d):
    u = _usage(s, d)
    zero = F.lit(0)
    fresh = F.sum(state.cost(F.col("input_tokens") + F.col("written") + F.col("read"), zero, zero, F.col("output_tokens")))
    cached = F.sum(state.cost(F.col("input_tokens"), F.col("written"), F.col("read"), F.col("output_tokens")))
    return u.agg(fresh.alias("f"), cached.alias("c")).select(F.round("f", 6).alias("fresh"), F.round("c", 6).alias("cached"), F.round((1 - F.col("c") / F.col("f")) * 100, 4).alias("reduction_pct"))


def _nearest(s, d):
    e = table(s, d, "events")
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("rid"), F.col("ts").alias("rts"))
    return state.nearest_in_time(left, right)


def _cached(s, d):
    calls = _usage(s, d).select("user_id", F.col("event_id").alias("id"), "ts")
    return state.cache_events(calls, "user_id", 86_400).select("id", "user_id", "cache")


def _turns(s, d):
    """Each turn with the next one of its conversation as the answer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(s, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("context", F.lead("text", 2).over(w))
    return t.where("answer IS NOT NULL").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"), "answer", F.coalesce("context", F.lit("")).alias("context"), F.col("text").alias("reference"))


def _text_metric(name):
    return lambda s, d: _turns(s, d).select("id", F.round(generation.text_metric(name, F.col("answer"), F.col("reference")), 6).alias(name))


def _cites(s, d):
    hrefs = F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))
    return table(s, d, "pages").select("page_id", F.array_sort(F.array_distinct(hrefs)).alias("cites"), F.length(F.regexp_replace("html", r'href="/[^"]*"', "")).cast("long").alias("rest"))


def _window(*spec):
    def run(s, d):
        e = table(s, d, "events")
        w = F.session_window("ts", spec[0]) if len(spec) == 1 and spec[0].startswith("30") else F.window("ts", *spec)
        keys = ["user_id", w.alias("w")] if spec[0].startswith("30") else [w.alias("w"), "event_type"]
        g = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        first = "user_id" if spec[0].startswith("30") else "event_type"
        return g.select(first, F.col("w.start").cast("timestamp_ntz").alias("starts"), "n", "total")

    return run


QUERIES = {
    "router_heuristic": _routes,
    "router_confusion": lambda s, d: _routes(s, d).groupBy("role", "route").agg(F.count(F.lit(1)).alias("n")),
    "router_centroid": _centroid_route,
    "router_accuracy": _accuracy,
    "scores_parse": lambda s, d: _literal(s, OUTPUTS, "o").select("id", F.transform(grade.parsed_scores(F.col("o"), F.lit(4)), lambda x: x.cast("long")).alias("scores"), grade.verdict(grade.parsed_scores(F.col("o"), F.lit(4))).alias("verdict")),
    "listwise_parse": lambda s, d: _literal(s, RANKINGS, "o").select("id", F.transform(grade.parsed_order(F.col("o"), F.lit(4)), lambda x: x.cast("long")).alias("places")),
    "lines_parse": lambda s, d: _literal(s, LISTED, "o").select("id", F.explode(grade.parsed_lines(F.col("o"))).alias("line")),
    "triples_parse": lambda s, d: _literal(s, TRIPLES, "o").select("id", F.explode(grade.extracted_triples(F.col("o"))).alias("t")).select("id", "t.s", "t.r", "t.o"),
    "crag_verdict": _judge,
    "crag_refine": _refine,
    "rerank_overlap": _rerank,
    "compress_extractive": _compress,
    "compression_ratio": _ratio,
    "context_join": lambda s, d: grade.context(_asked(s, d).select("query_id").join(_candidates(s, d, 3).select("query_id", "rank", "text"), "query_id", "left")),
    "naive_vs_pool_vs_final": _stages,
    "self_rag_trace": _self_rag,
    "adaptive_pipeline": _adaptive,
    "graph_build": lambda s, d: graph.built(_edges(s, d).select(F.col("src").alias("s"), F.col("relationship").alias("r"), F.col("dst").alias("o"), "source_chunk"), table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.concat(F.lit("B:"), "p_brand").alias("canonical"))).groupBy("dst", "relationship").agg(F.count(F.lit(1)).alias("n_edges")),
    "graph_counts": lambda s, d: _edges(s, d).agg(F.count(F.lit(1)).alias("n_edges"), (F.countDistinct("src") + F.countDistinct("dst")).alias("n_nodes")),
    "local_search_1hop": _hops(1),
    "local_search_2hop": _hops(2),
    "connected_components": lambda s, d: graph.components(_geography(s, d)),
    "community_edges": lambda s, d: graph.inner_edges(_geography(s, d), _regions(s, d)),
    "community_summaries": lambda s, d: graph.summaries(_geography(s, d), _regions(s, d)),
    "communities_louvain": lambda s, d: graph.louvain(_geography(s, d)),
    "global_mapreduce": _global,
    "entity_dedup": _fold(0.88, "canonical"),
    "entity_dedup_loose": _fold(0.3, "canonical"),
    "semantic_cache": _fold(0.85, "answered_by"),
    "cache_hit_rate": _cache_rate,
    "nearest_frame": _nearest,
    "cost_by_stage": _cost,
    "fresh_vs_cached": _fresh_cached,
    "cache_write_read": _cached,
    "latency_share": lambda s, d: state.shares(_usage(s, d).select("event_id", "user_id", "value"), "user_id", "value").select("event_id", F.round("share", 9).alias("share")),
    "bleu": _text_metric("bleu"),
    "rouge_l": _text_metric("rouge_l"),
    "meteor": _text_metric("meteor"),
    "semantic_sim": lambda s, d: _turns(s, d).select("id", F.round(generation.bag_similarity(F.col("answer"), F.col("reference")), 6).alias("sim")),
    "judged_answers": lambda s, d: generation.judged(_turns(s, d)),
    "cites_extract": _cites,
    "rollup_metrics": lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level")),
    "events_tumbling": _window("1 hour"),
    "events_sliding": _window("2 hours", "1 hour"),
    "events_session": _window("30 minutes"),
    "approx_distinct": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("n_users")),
}

_CAND = lambda k: f"WITH {_BM}, h AS ({_RANK('SELECT * FROM b', k)}), c AS (SELECT h.query_id, h.item_id, h.rank, h.score, d.text, q.text AS query FROM h JOIN documents d ON d.doc_id = h.item_id JOIN benchmark q ON q.item_id = h.query_id)"
_SHARE = lambda q, t: f"CASE WHEN len({_TOK.format(q)}) > 0 THEN len(list_intersect(list_distinct({_TOK.format(q)}), {_TOK.format(t)}))::DOUBLE / len(list_distinct({_TOK.format(q)})) ELSE 0 END"
_ROUTE = """CASE WHEN (contains(lower(text), ' and ') OR contains(lower(text), ' as well as ')) AND length(text) - length(replace(text, '?', '')) <= 1 AND contains(text, ',') THEN 'COMPOUND'
  WHEN regexp_matches(lower(text), 'dont|didnt|just |how come|everyone') THEN 'VAGUE' WHEN regexp_matches(lower(text), 'value|rate did|parameter') THEN 'NEEDS_CONTEXT'
  WHEN regexp_matches(lower(text), 'why is|why did|what lets|what makes|how does') THEN 'BROAD' ELSE 'CLEAR' END"""
_CEN = "cen AS (SELECT label AS cell, list(m ORDER BY dim) AS centroid FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS dim FROM v) GROUP BY label, dim) GROUP BY label)"
_CROUTE = f"WITH {_V}, {_CEN} SELECT item_id, label::BIGINT AS truth, cell::BIGINT AS route FROM v, cen QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round({_DOT.format('vec', 'centroid')} / (sqrt({_DOT.format('vec', 'vec')}) * sqrt({_DOT.format('centroid', 'centroid')}) + 1e-8), 9) DESC, cell) = 1"
_SENT = lambda x: rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: regexp_replace(z, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')), lambda z: length(z) > 0)"
_REFINE = _CAND(5) + f""", p AS (SELECT query_id, query, rank, text FROM c),
  s AS (SELECT query_id, query, rank, unnest({_SENT('text')}) AS x, generate_subscripts({_SENT('text')}, 1) AS pos FROM p),
  k AS (SELECT * FROM s WHERE length(x) > 20 AND 1 + floor(4 * ({_SHARE('x', 'query')})) >= 3),
  g AS (SELECT query_id, string_agg(x, chr(10) ORDER BY rank, pos) AS text FROM k GROUP BY 1)
  SELECT * FROM g UNION ALL SELECT query_id, string_agg(text, chr(10) ORDER BY rank) FROM p ANTI JOIN g USING (query_id) GROUP BY 1"""
_RERANKED = lambda src, k=3: f"SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, item_id) AS rank FROM (SELECT query_id, item_id, rank AS old, text, round({_SHARE('query', 'text')}, 6) AS score FROM {src}) QUALIFY rank <= {k}"
_COMP = f"z AS (SELECT query_id, item_id, length(text) AS before, array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: len(list_intersect(list_distinct({_TOK.format('query')}), {_TOK.format('y')})) / greatest(1, len(list_distinct({_TOK.format('query')})))::DOUBLE >= 0.2::DOUBLE), ' ') AS text FROM c)"
_STAGE = lambda name, src: f"(SELECT query_id, string_agg(lower(d.text), ' ' ORDER BY rank) AS t FROM ({src}) x JOIN documents d ON d.doc_id = x.item_id GROUP BY 1) {name}"
_E = "SELECT 'O' || l_orderkey AS src, 'P' || l_partkey AS dst, l_returnflag AS relationship, l_linenumber::BIGINT AS source_chunk FROM lineitem"
_SEED = f"SELECT query_id, 'P' || item_id AS node FROM ({_TOP(3)})"
_HOP = lambda frontier: f"SELECT DISTINCT f.query_id, e.* FROM e JOIN ({frontier}) f ON e.src = f.node OR e.dst = f.node"
_COUNT = "SELECT query_id, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM ({0}) GROUP BY 1"
_GEO = "geo AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"
_CC = f"{_GEO}, reach AS (SELECT node, min(other) AS comp FROM (WITH RECURSIVE w(node, other) USING KEY (node, other) AS (SELECT src, src FROM geo UNION SELECT dst, dst FROM geo UNION SELECT w.node, CASE WHEN g.src = w.other THEN g.dst ELSE g.src END FROM w JOIN geo g ON g.src = w.other OR g.dst = w.other) SELECT node, other FROM w) GROUP BY node)"
_CC = _CC.replace(" USING KEY (node, other)", "")
_SUMM = "m AS (SELECT a.comp AS community, g.src || ' -> in -> ' || g.dst AS line FROM geo g JOIN reach a ON a.node = g.src JOIN reach b ON b.node = g.dst AND a.comp = b.comp), sm AS (SELECT community, string_agg(line, chr(10) ORDER BY line) AS summary, count(*) AS n FROM m GROUP BY 1)"
_COST = "input_tokens / 1000000.0::DOUBLE * 2 + written / 1000000.0::DOUBLE * 2 * 1.25::DOUBLE + read / 1000000.0::DOUBLE * 2 * 0.1::DOUBLE + output_tokens / 1000000.0::DOUBLE * 10"
_USE = "u AS (SELECT event_id, user_id, ts, event_type AS stage, value, (props->>'$.k')::BIGINT AS input_tokens, event_id % 50 AS written, event_id % 1000 AS read, event_id % 200 AS output_tokens FROM events)"
_TURN = "t AS (SELECT conv_id * 100 + turn AS id, text AS question, lead(text) OVER w AS answer, coalesce(lead(text, 2) OVER w, '') AS context, text AS reference FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY answer IS NOT NULL)"
_SUP = lambda a, b: f"coalesce(len(list_filter({_SENT(a)}, lambda z: len(list_intersect(list_distinct({_TOK.format('z')}), {_TOK.format(b)})) >= 0.5::DOUBLE * len(list_distinct({_TOK.format('z')}))))::DOUBLE / nullif(len({_SENT(a)}), 0), 0)"
_PAIR = lambda a, b: f"coalesce(len(list_intersect(list_distinct({_TOK.format(a)}), {_TOK.format(b)}))::DOUBLE / nullif(len(list_distinct({_TOK.format(a)})), 0), 0)"

#: The fold in id order, one item a step, its leaders so far in a list.
_LEADERS = f"""WITH RECURSIVE {_V}, p AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b, round({_DOT.format('a.vec', 'b.vec')} / (sqrt({_DOT.format('a.vec', 'a.vec')}) * sqrt({_DOT.format('b.vec', 'b.vec')}) + 1e-8), 9) AS sim FROM v a JOIN v b ON a.item_id < b.item_id),
  o AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n, coalesce((SELECT list(p.a ORDER BY p.sim DESC, p.a) FROM p WHERE p.b = v.item_id AND p.sim >= {{0}}::DOUBLE), []) AS near FROM v),
  w(n, item_id, leader, leads) AS (SELECT n, item_id, item_id, [item_id] FROM o WHERE n = 1
    UNION ALL SELECT o.n, o.item_id, coalesce(list_filter(o.near, lambda x: list_contains(w.leads, x))[1], o.item_id),
      CASE WHEN len(list_filter(o.near, lambda x: list_contains(w.leads, x))) = 0 THEN list_append(w.leads, o.item_id) ELSE w.leads END FROM w JOIN o ON o.n = w.n + 1)
  SELECT w.item_id, w.leader AS {{1}}, p.sim FROM w LEFT JOIN p ON p.b = w.item_id AND p.a = w.leader"""
SQL = {
    "router_heuristic": f"SELECT conv_id, turn, role, {_ROUTE} AS route FROM conversations",
    "router_confusion": f"SELECT role, {_ROUTE} AS route, count(*) AS n FROM conversations GROUP BY ALL",
    "router_centroid": _CROUTE,
    "router_accuracy": f"SELECT truth, count(*) AS n, round(avg(CASE WHEN truth = route THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM ({_CROUTE}) GROUP BY truth",
    "scores_parse": "SELECT * FROM (VALUES (0::BIGINT, [5, 1, 2, 1]::BIGINT[], 'Correct'), (1, [5, 1, 1, 1], 'Correct'), (2, [1, 1, 1, 1], 'Incorrect'), (3, [1, 1, 1, 1], 'Incorrect'), (4, [3, 3, 3, 3], 'Ambiguous')) t(id, scores, verdict)",
    "listwise_parse": "SELECT * FROM (VALUES (0::BIGINT, [3, 1, 2, 4]::BIGINT[]), (1, [1, 2, 3, 4]), (2, [1, 2, 3, 4]), (3, [4, 2, 1, 3])) t(id, places)",
    "lines_parse": "SELECT * FROM (VALUES (0::BIGINT, 'one'), (0, 'two'), (0, 'three'), (2, 'solo')) t(id, line)",
    "triples_parse": "SELECT * FROM (VALUES (0::BIGINT, 'A', 'r', 'B'), (0, 'C', 's', 'D'), (3, 'P', 'q', 'R')) t(id, s, r, o)",
    "crag_verdict": f"{_CAND(5)} SELECT query_id, top, n, CASE WHEN top >= 4 THEN 'Correct' WHEN top <= 2 THEN 'Incorrect' ELSE 'Ambiguous' END AS verdict FROM (SELECT query_id, max((1 + floor(4 * ({_SHARE('query', 'text')})))::BIGINT) AS top, count(*) AS n FROM c GROUP BY 1)",
    "crag_refine": _REFINE,
    "rerank_overlap": f"{_CAND(10)} {_RERANKED('c')}",
    "compress_extractive": f"{_CAND(3)}, {_COMP} SELECT query_id, item_id, before, text, length(text) AS after FROM z WHERE text <> ''",
    "compression_ratio": f"{_CAND(3)}, {_COMP} SELECT round(1 - (SELECT sum(length(text)) FROM z) / (SELECT sum(length(text)) FROM c)::DOUBLE, 6) AS reduction",
    "context_join": f"{_CAND(3)} SELECT q.item_id AS query_id, coalesce(string_agg(c.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '(no context available)') AS context FROM benchmark q LEFT JOIN c ON c.query_id = q.item_id GROUP BY 1",
    "naive_vs_pool_vs_final": f"""{_CAND(15)}, f AS ({_RERANKED('c')}), k AS (SELECT item_id AS query_id, string_split(lower(text), ' ')[1:3] AS keys FROM benchmark)
      SELECT k.query_id, {', '.join(f"len(list_filter(keys, lambda y: NOT contains(coalesce({n}.t, ''), y))) = 0 AS {c}" for n, c in (('a1', 'naive'), ('a2', 'pool'), ('a3', 'final')))}
      FROM k LEFT JOIN {_STAGE('a1', 'SELECT * FROM h WHERE rank <= 2')} ON a1.query_id = k.query_id LEFT JOIN {_STAGE('a2', 'SELECT * FROM h')} ON a2.query_id = k.query_id LEFT JOIN {_STAGE('a3', 'SELECT * FROM f')} ON a3.query_id = k.query_id""",
    "graph_build": f"SELECT CASE WHEN p.p_partkey IS NULL THEN dst ELSE 'B:' || p_brand END AS dst, relationship, count(*) AS n_edges FROM ({_E}) LEFT JOIN part p ON dst = 'P' || p.p_partkey GROUP BY ALL",
    "graph_counts": f"SELECT count(*) AS n_edges, count(DISTINCT src) + count(DISTINCT dst) AS n_nodes FROM ({_E})",
    "local_search_1hop": f"WITH e AS ({_E}) {_COUNT.format(_HOP(_SEED))}",
    "local_search_2hop": f"WITH e AS ({_E}), h1 AS ({_HOP(_SEED)}) {_COUNT.format('SELECT DISTINCT f.query_id, e.* FROM e JOIN (SELECT query_id, src AS node FROM h1 UNION SELECT query_id, dst FROM h1 UNION ' + _SEED + ') f ON e.src = f.node UNION SELECT DISTINCT f.query_id, e.* FROM e JOIN (SELECT query_id, src AS node FROM h1 UNION SELECT query_id, dst FROM h1 UNION ' + _SEED + ') f ON e.dst = f.node')}",
    "connected_components": f"WITH {_CC} SELECT node, comp FROM reach",
    "community_edges": f"WITH {_CC} SELECT a.comp AS community, g.src, 'in' AS relationship, g.dst FROM geo g JOIN reach a ON a.node = g.src JOIN reach b ON b.node = g.dst AND a.comp = b.comp",
    "community_summaries": f"WITH {_CC}, {_SUMM} SELECT community, summary FROM sm",
    "global_mapreduce": f"WITH {_CC}, {_SUMM} SELECT coalesce(string_agg(community || ': ' || n, '; ' ORDER BY community || ': ' || n), 'no relevant community') AS answer FROM sm WHERE n >= 5",
    "nearest_frame": """SELECT p.event_id AS id, v.event_id AS rid, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS gap_us FROM events p, events v WHERE p.event_type = 'purchase' AND v.event_type = 'view'
      QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, v.event_id) = 1""",
    "cost_by_stage": f"WITH {_USE} SELECT stage, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(avg(input_tokens), 6) AS avg_input, round(sum({_COST}), 6) AS cost FROM u GROUP BY 1",
    "fresh_vs_cached": f"WITH {_USE}, x AS (SELECT sum((input_tokens + written + read) / 1000000.0::DOUBLE * 2 + output_tokens / 1000000.0::DOUBLE * 10) AS f, sum({_COST}) AS c FROM u) SELECT round(f, 6) AS fresh, round(c, 6) AS cached, round((1 - c / f) * 100, 4) AS reduction_pct FROM x",
    "cache_write_read": "SELECT event_id AS id, user_id, CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 86400000000 THEN 'WRITE' ELSE 'READ' END AS cache FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)",
    "latency_share": "SELECT event_id, round(value / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM events",
    "semantic_sim": f"""WITH {_TURN}, a AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({_TOK.format('answer')}) AS w FROM t) GROUP BY ALL), r AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({_TOK.format('reference')}) AS w FROM t) GROUP BY ALL)
      SELECT t.id, round(coalesce((SELECT sum(a.n * r.n) FROM a JOIN r ON a.id = r.id AND a.w = r.w WHERE a.id = t.id) / (sqrt((SELECT sum(n * n) FROM a WHERE a.id = t.id)) * sqrt((SELECT sum(n * n) FROM r WHERE r.id = t.id))), 0), 6) AS sim FROM t""",
    "judged_answers": f"""WITH {_TURN}, x AS (SELECT *, {_PAIR('answer', 'reference')} AS p, {_PAIR('reference', 'answer')} AS r FROM t)
      SELECT id, round({_SUP('answer', 'context')}, 6) AS faithfulness, round({_PAIR('question', 'answer')}, 6) AS relevancy, round({_SUP('reference', 'context')}, 6) AS context_recall,
      round({_PAIR('context', 'reference')}, 6) AS context_precision, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS correctness, round(1 - {_SUP('answer', 'reference')}, 6) AS noise FROM x""",
    "cites_extract": """SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS cites, length(regexp_replace(html, 'href="/[^"]*"', '', 'g')) AS rest FROM pages""",
    "rollup_metrics": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping_id(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "entity_dedup": _LEADERS.format(0.88, "canonical"),
    "entity_dedup_loose": _LEADERS.format(0.3, "canonical"),
    "semantic_cache": _LEADERS.format(0.85, "answered_by"),
    "cache_hit_rate": f"SELECT count(*) AS n, round(avg(CASE WHEN item_id <> answered_by THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate FROM ({_LEADERS.format(0.85, 'answered_by')})",
    "events_tumbling": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS starts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS starts, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL",
    "events_session": """SELECT user_id, min(ts) AS starts, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, grp""",
}

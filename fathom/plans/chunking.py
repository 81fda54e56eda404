"""Queries of the chunkers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.text import from_marker
from fathom.operators import chunk
from fathom.sources.tables import table

_DOCS = lambda s, d: table(s, d, "documents").select("doc_id", "text")
#: DuckDB: stripped text and sentences, as the expressions of functions.text give them.
STRIP = r"regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"
SENTENCES = r"string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
MARKDOWN = "# Guide\nIntro line.\n\n## Setup\nInstall it.\n### Linux\nUse the shell.\n## Usage\nRun it.\n# Notes\n\nLast words.\n"


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _fixed(s, d):
    return _long(chunk.windows(_DOCS(s, d), "doc_id", 800, 100), "pos", "start")


def _min40(s, d):
    return _long(chunk.windows(_DOCS(s, d), "doc_id", 400, 50, 40), "pos", "start")


def _splitter(s, d):
    return _long(chunk.windows(_DOCS(s, d), "doc_id", 512, 50, 1, pure_tail=False), "pos", "start")


def _dense(s, d):
    rows = chunk.windows(_DOCS(s, d), "doc_id", 400, 50, 40)
    return _long(chunk.dense_ids(rows.select("doc_id", "pos"), ["doc_id", "pos"]), "pos").select("chunk_id", "doc_id", "pos")


def _sections(s, d):
    return _long(chunk.sections(chunk.windows(_DOCS(s, d), "doc_id", 400, 50, 40), "doc_id"), "n_chunks")


def _pages(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("\f")), "\f")).alias("page", "text"))
    return rows.select("doc_id", (F.col("page") + 1).cast("long").alias("page"), "text").where("text <> ''")


def _recursive(s, d):
    return _long(chunk.recursive(_DOCS(s, d), "doc_id"), "pos")


def _markdown(s, d):
    docs = s.createDataFrame([(1, MARKDOWN)], "doc_id long, text string")
    return chunk.headed(docs, "doc_id").select("doc_id", "path", "text")


def _html(s, d):
    return _long(chunk.html_sections(table(s, d, "pages"), "page_id"), "pos")


def _semantic(s, d):
    return _long(chunk.semantic(_DOCS(s, d), "doc_id", 0.2), "pos", "n_sentences")


def _coherence(s, d):
    rows = chunk.coherence(chunk.sentence_groups(_DOCS(s, d), "doc_id"), "doc_id")
    return rows.select("doc_id", F.round("coherence", 6).alias("coherence"))


def _adaptive(s, d):
    makers = {"sentence": lambda x: chunk.sentence_groups(x, "doc_id"), "fixed": lambda x: chunk.windows(x, "doc_id", 400, 50, 40), "pairs": lambda x: chunk.sentence_groups(x, "doc_id", 3, 0)}
    return chunk.best_strategy(_DOCS(s, d), "doc_id", makers)


def _trim(s, d):
    return table(s, d, "pages").select("page_id", from_marker(F.col("html"), "<article>").alias("text"))


def _late(s, d):
    rows = chunk.pooled(chunk.windows(_DOCS(s, d), "doc_id", 400, 50, 40), "doc_id")
    return _long(rows, "pos").groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n_dims"), F.round(F.sum(F.abs("w")), 6).alias("mass"))


def _propositions(s, d):
    # the offline generator: a JSON list of the sentences for even ids, plain text for odd ones
    docs = _DOCS(s, d).withColumn("output", F.when(F.col("doc_id") % 2 == 0, F.to_json(chunk.sentences(F.col("text")))).otherwise(F.col("text")))
    return _long(docs.select("doc_id", F.posexplode(chunk.parsed_propositions(docs)).alias("pos", "fact")), "pos")


def _boundaries(s, d):
    rows = chunk.by_boundaries(_DOCS(s, d), "doc_id", lambda before, now: F.length(before) > 80)
    return _long(rows, "pos")


QUERIES = {
    "chunk_fixed": _fixed,
    "chunk_fixed_min40": _min40,
    "chunk_splitter_fixed": _splitter,
    "chunk_dense_ids": _dense,
    "chunk_sentences": lambda s, d: _long(chunk.sentence_rows(_DOCS(s, d), "doc_id"), "pos"),
    "chunk_sentence_window": lambda s, d: _long(chunk.sentence_windows(_DOCS(s, d), "doc_id"), "pos").select("doc_id", "pos", "context"),
    "chunk_sentence_groups": lambda s, d: _long(chunk.sentence_groups(_DOCS(s, d), "doc_id"), "pos"),
    "strips": lambda s, d: _long(chunk.strips(_DOCS(s, d), "doc_id"), "pos"),
    "chunk_small_to_big": lambda s, d: _long(chunk.small_to_big(_DOCS(s, d), "doc_id"), "parent_pos", "pos"),
    "chunk_sections": _sections,
    "chunk_recursive": _recursive,
    "chunk_pages": _pages,
    "chunk_structure_markdown": _markdown,
    "chunk_structure_html": _html,
    "chunk_semantic": _semantic,
    "coherence": _coherence,
    "adaptive_chunk": _adaptive,
    "front_matter_trim": _trim,
    "chunk_late": _late,
    "chunk_propositions": _propositions,
    "chunk_boundaries": _boundaries,
}


def windows_sql(size: int, overlap: int, min_chars: int, last: str = "length(text)", strip: bool = True, source: str = "documents") -> str:
    piece = f"substring(text, start + 1, {size})"
    return f"""SELECT doc_id, (start // {size - overlap})::BIGINT AS pos, start::BIGINT AS start, t AS text FROM (
      SELECT doc_id, start, {STRIP.format(piece) if strip else piece} AS t
      FROM (SELECT doc_id, text, unnest(range(0, {last}, {size - overlap})) AS start FROM {source}))
    WHERE length(t) >= {min_chars}"""


_S = f"SELECT doc_id, unnest({SENTENCES.format('text')}) AS text, generate_subscripts({SENTENCES.format('text')}, 1) - 1 AS pos FROM documents"
_GROUPS = lambda n, overlap, source="documents": f"""SELECT doc_id, pos, t AS text FROM (SELECT doc_id, (start // {n - overlap})::BIGINT AS pos, {STRIP.format(f"array_to_string(s[start + 1:start + {n}], ' ')")} AS t
    FROM (SELECT doc_id, s, unnest(range(0, len(s), {n - overlap})) AS start FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM {source}))) WHERE length(t) >= 40"""  # noqa: E731
_WORDS = lambda source, keys: f"SELECT {keys}, token FROM (SELECT {keys}, unnest(string_split(lower(text), ' ')) AS token FROM {source}) WHERE token <> ''"
_HASHED = lambda words, keys, dims=32: f"""SELECT {keys}, dim, sum(sg)::BIGINT AS w FROM (SELECT {keys}, h % {dims} AS dim, CASE WHEN (h // {dims}) % 2 = 0 THEN 1 ELSE -1 END AS sg
    FROM (SELECT {keys}, ('0x' || substring(md5(token), 1, 8))::BIGINT AS h FROM ({words}))) GROUP BY ALL HAVING sum(sg) <> 0"""  # noqa: E731
_ADJACENT = f"""
 s AS ({_S}), v AS ({_HASHED(_WORDS('s', 'doc_id, pos'), 'doc_id, pos')}),
 n AS (SELECT doc_id, pos, sum(w * w)::BIGINT AS n2 FROM v GROUP BY ALL),
 dd AS (SELECT a.doc_id, a.pos, sum(a.w * b.w)::BIGINT AS d FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.pos = b.pos + 1 AND a.dim = b.dim GROUP BY ALL),
 adj AS (SELECT s.doc_id, s.pos, s.text, CASE WHEN s.pos > 0 THEN coalesce(dd.d / (sqrt(p.n2) * sqrt(n.n2)), 0) END AS sim
   FROM s LEFT JOIN n USING (doc_id, pos) LEFT JOIN n p ON p.doc_id = s.doc_id AND p.pos = s.pos - 1 LEFT JOIN dd ON dd.doc_id = s.doc_id AND dd.pos = s.pos)"""


def _coherence_sql(chunks: str, name: str) -> str:
    return f"""
 {name}_c AS ({chunks}),
 {name}_r AS (SELECT doc_id, pos AS chunk, unnest({SENTENCES.format('text')}) AS text, generate_subscripts({SENTENCES.format('text')}, 1) AS pos FROM {name}_c),
 {name}_v AS ({_HASHED(_WORDS(name + '_r', 'doc_id, chunk, pos'), 'doc_id, chunk, pos')}),
 {name}_n AS (SELECT doc_id, chunk, pos, sqrt(sum(w * w)) AS n FROM {name}_v GROUP BY ALL),
 {name}_p AS (SELECT a.doc_id, a.chunk, a.pos AS i, b.pos AS j, coalesce(sum(x.w * y.w) / (any_value(na.n) * any_value(nb.n)), 0) AS c
   FROM {name}_r a JOIN {name}_r b ON a.doc_id = b.doc_id AND a.chunk = b.chunk AND a.pos < b.pos
   LEFT JOIN {name}_n na ON na.doc_id = a.doc_id AND na.chunk = a.chunk AND na.pos = a.pos LEFT JOIN {name}_n nb ON nb.doc_id = b.doc_id AND nb.chunk = b.chunk AND nb.pos = b.pos
   LEFT JOIN {name}_v x ON x.doc_id = a.doc_id AND x.chunk = a.chunk AND x.pos = a.pos LEFT JOIN {name}_v y ON y.doc_id = b.doc_id AND y.chunk = b.chunk AND y.pos = b.pos AND y.dim = x.dim
   GROUP BY a.doc_id, a.chunk, a.pos, b.pos),
 {name}_s AS (SELECT doc_id, round(coalesce(avg(m), 0), 6) AS coherence FROM (SELECT DISTINCT doc_id FROM {name}_c) LEFT JOIN (SELECT doc_id, chunk, avg(c) AS m FROM {name}_p GROUP BY ALL) USING (doc_id) GROUP BY doc_id)"""


_MD = "doc_id, path, text) AS (VALUES (1::BIGINT, 'Guide', 'Intro line.'), (1, 'Guide > Setup', 'Install it.'), (1, 'Guide > Setup > Linux', 'Use the shell.'), (1, 'Guide > Usage', 'Run it.'), (1, 'Notes', 'Last words.')) SELECT * FROM t"
_PLAIN = lambda c: rf"trim(regexp_replace(regexp_replace({c}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"

SQL = {
    "chunk_fixed": windows_sql(800, 100, 1),
    "chunk_fixed_min40": windows_sql(400, 50, 40),
    "chunk_splitter_fixed": windows_sql(512, 50, 1, "CASE WHEN length(text) > 0 THEN greatest(1, length(text) - 50) ELSE 0 END"),
    "chunk_dense_ids": f"SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, pos FROM ({windows_sql(400, 50, 40)})",
    "chunk_sentences": f"SELECT doc_id, pos, text FROM ({_S})",
    "chunk_sentence_window": f"SELECT doc_id, pos, string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM ({_S})",
    "chunk_sentence_groups": _GROUPS(5, 1),
    "strips": f"SELECT doc_id, pos, {STRIP.format('text')} AS text FROM ({_S}) WHERE length({STRIP.format('text')}) > 20",
    "chunk_small_to_big": f"""SELECT doc_id, parent_pos, (start // 250)::BIGINT AS pos, t AS text FROM (SELECT doc_id, parent_pos, start, {STRIP.format('substring(p, start + 1, 250)')} AS t FROM (
        SELECT doc_id, pos AS parent_pos, text AS p, unnest(range(0, length(text), 250)) AS start FROM ({windows_sql(1500, 0, 1, strip=False)}))) WHERE t <> ''""",
    "chunk_sections": f"""SELECT doc_id, (n // 5)::BIGINT AS section, count(*) AS n_chunks, string_agg(text, ' ' ORDER BY n) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM ({windows_sql(400, 50, 40)})) GROUP BY ALL""",
    "chunk_pages": r"SELECT doc_id, page::BIGINT AS page, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents) WHERE text <> ''",
    "chunk_structure_markdown": f"WITH t({_MD}",
    "chunk_structure_html": rf"""SELECT page_id, (i - 1)::BIGINT AS pos, {_PLAIN("regexp_extract(part, '(?s)^<h[1-3][^>]*>(.*?)</h[1-3]>', 1)")} AS heading,
        {_PLAIN("regexp_replace(part, '(?s)^<h[1-3][^>]*>.*?</h[1-3]>', '')")} AS text
        FROM (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '(<h[1-3][ >])', chr(1) || '\1', 'g'), chr(1)) AS p FROM pages))
        WHERE {_PLAIN("regexp_replace(part, '(?s)^<h[1-3][^>]*>.*?</h[1-3]>', '')")} <> ''""",
    "chunk_semantic": f"""WITH {_ADJACENT}, g AS (SELECT *, sum(CASE WHEN coalesce(sim, 1) < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM adj)
        SELECT doc_id, grp::BIGINT AS pos, count(*) AS n_sentences, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, grp""",
    "coherence": f"WITH {_coherence_sql(_GROUPS(5, 1), 'a')} SELECT * FROM a_s",
    "adaptive_chunk": f"""WITH {_coherence_sql(_GROUPS(5, 1), 'a')}, {_coherence_sql(windows_sql(400, 50, 40), 'b')}, {_coherence_sql(_GROUPS(3, 0), 'c')},
        u AS (SELECT doc_id, 0 AS i, 'sentence' AS strategy, coherence FROM a_s UNION ALL SELECT doc_id, 1, 'fixed', coherence FROM b_s UNION ALL SELECT doc_id, 2, 'pairs', coherence FROM c_s)
        SELECT doc_id, strategy, coherence FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coherence DESC, i) = 1""",
    "front_matter_trim": "SELECT page_id, CASE WHEN strpos(html, '<article>') > 0 THEN substring(html, strpos(html, '<article>')) ELSE html END AS text FROM pages",
    "chunk_late": f"""WITH c AS ({windows_sql(400, 50, 40)}), t AS ({_WORDS('c', 'doc_id, pos')}), n AS (SELECT doc_id, pos, count(*) AS n FROM t GROUP BY ALL),
        v AS ({_HASHED('SELECT * FROM t', 'doc_id, pos')}), dv AS (SELECT doc_id, dim, sum(w) AS wd FROM v GROUP BY ALL), dn AS (SELECT doc_id, sum(n) AS nd FROM n GROUP BY ALL)
        SELECT n.doc_id, n.pos, count(*) AS n_dims, round(sum(abs(coalesce(v.w, 0) / n.n + 0.5::DOUBLE * dv.wd / dn.nd)), 6) AS mass
        FROM n JOIN dv USING (doc_id) JOIN dn USING (doc_id) LEFT JOIN v ON v.doc_id = n.doc_id AND v.pos = n.pos AND v.dim = dv.dim GROUP BY n.doc_id, n.pos""",
    "chunk_propositions": f"""SELECT doc_id, (generate_subscripts(f, 1) - 1)::BIGINT AS pos, unnest(f) AS fact FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {SENTENCES.format('text')} ELSE [text] END AS f FROM documents)""",
    "chunk_boundaries": f"""SELECT doc_id, grp::BIGINT AS pos, string_agg(text, ' ' ORDER BY pos) AS text FROM (SELECT *, sum(CASE WHEN before > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp
        FROM (SELECT *, length(lag(text) OVER (PARTITION BY doc_id ORDER BY pos)) AS before FROM ({_S}))) GROUP BY doc_id, grp""",
}

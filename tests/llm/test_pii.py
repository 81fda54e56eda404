"""Base spans against a plain reading of the rules, redaction, and the added spans."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text: str) -> list[tuple[int, int, int]]:
    return sorted((m.start(), i, m.end()) for i, (k, rx) in enumerate(RULES.items()) for m in re.finditer(rx, text) if accepted(k, m[0]))


def digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(text)).encode()).hexdigest()


TEXTS = [
    "", "mail a.b@c.de, a@b.c_d@e.f and x@y", "é𝄞 10.0.0.255 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 or 4111-1111-1111-1112 5-4111111111111111",
    "call +1 (743) 555-3824. or +49 30 1234567 89 +1", "1 " * 9000, "a" * 50_000, "1.2" * 3000, "x@" + "a." * 6000 + "b", "9" * 4000, "+1" + " (" * 4000, "@@ a@b.c@d.e a@-.-",
    "12  3456 4111111111111111 4111111111111111 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a@b.c a@b..c a@b.c.d.", "\n+1-222-333-4444\n1.1.1.1@a.b",
]


def results(spark, docs, texts):
    found = pii.with_spans(docs(list(enumerate(texts))))
    rows = found.select("doc_id", "pii_base", "pii_spans").collect()
    return {r["doc_id"]: ([(x["s"], x["o"], x["e"]) for x in r["pii_base"]], [(x["s"], x["o"], x["e"]) for x in r["pii_spans"]]) for r in rows}


def test_fixed_texts(spark, docs):
    got = results(spark, docs, TEXTS)
    for i, text in enumerate(TEXTS):
        assert got[i][0] == brute(text), text[:80]
        assert set(got[i][0]) <= set(got[i][1])


@given(st.lists(st.text(alphabet="a1@.+- (9)é\n", max_size=40), min_size=60, max_size=60))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text(spark, docs, texts):
    got = results(spark, docs, texts)
    assert [got[i][0] for i in range(len(texts))] == [brute(t) for t in texts]


def test_added_spans(spark, docs):
    texts = ["please write to jo.doe[at]mer[dot]com today", "call (743) 555-3824 now", "host 10[.]0[.]0[.]1 is down", "card 4111.1111.1111.1111 ok", "he sat at home. then left", "order 555 123 4567 units", "see version 1234.5678.9012.3456"]
    added = {i: set(v[1]) - set(v[0]) for i, v in results(spark, docs, texts).items()}
    assert [len(added[i]) for i in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    s, o, e = next(iter(added[1]))
    assert (texts[1][s:e], pii.KINDS[o]) == ("(743) 555-3824", "phone")


def test_overlapping_proposals(spark, docs):
    """Kinds propose at one place; the trees choose, and what is chosen neither touches a base span nor another choice."""
    texts = ["card 4111 . 1111 . 1111 . 1111", "pay with 4111.1111.1111.1111 or call 555-382-1234", "host 10 . 0 . 0 . 1 and 4111 1111 1111 1111", "jo @ mail.com or jo@mail.com", "10[.]0[.]0[.]1 4111_1111_1111_1111 (743) 555-3824"]
    found = docs(list(enumerate(texts))).select("doc_id", *[F.size(pii.proposals(F.col("text"), k)).alias(k) for k in pii.KINDS]).collect()
    assert all(sum(r[k] > 0 for k in pii.KINDS) > 1 for r in found if r["doc_id"] in (1, 2, 4))
    for i, (base, spans) in results(spark, docs, texts).items():
        assert base == brute(texts[i]) and set(base) <= set(spans)
        for x in set(spans) - set(base):
            assert not any(y != x and y[0] < x[2] and x[0] < y[2] for y in spans)


def test_resolution_against_brute_force(spark):
    rng = random.Random(2)
    pools = []
    for _ in range(60):
        pool = [(s := rng.randrange(60), rng.randrange(4), s + rng.randint(1, 12), rng.choice([float("inf"), 0.5, 1.0, 1.5])) for _ in range(rng.randint(0, 12))]
        pools.append(sorted(set(pool)))
    frame = spark.createDataFrame(list(enumerate(pools)), "id int, p array<struct<s:int,o:int,e:int,margin:double>>")
    got = {r["id"]: [tuple(x) for x in r["out"]] for r in frame.select("id", pii.resolved(F.col("p")).alias("out")).collect()}
    key = lambda x: (-x[3], x[0], -x[2], x[1])
    for i, pool in enumerate(pools):
        assert got[i] == [x for x in pool if x[3] == float("inf") or not any(key(y) < key(x) and y[0] < x[2] and x[0] < y[2] for y in pool)]


def test_held_out_examples(spark):
    """Proposals on words and contexts that neither training nor calibration saw."""
    for precision, recall in pii.report(spark).values():
        assert precision > 0.97 and recall > 0.9


def test_many_spans_and_clashing_columns(spark, docs):
    one = "a@b.cd +1 222 333 4444 x 1.2.3.4@c.de é "
    rows = [(1, one * 3000), (1, one * 3000), (2, "n"), (3, one * 40)]
    d = docs(rows).withColumns({"pii_base": F.lit(1), "base0": F.lit(2), "spans0": F.lit(3)})
    got = pii.redacted(d).collect()
    assert len(got) == 4 and got[0].asDict().keys() == set(d.columns)
    want = "[EMAIL] [PHONE] x [EMAIL] é "
    assert sorted({(r["doc_id"], r["text"]) for r in got}) == [(1, want * 3000), (2, "n"), (3, want * 40)]


def test_redaction_and_nulls(spark, docs):
    rows = {r["doc_id"]: r for r in pii.redacted(docs([(1, "é a@b.cd x +1 222 333 4444"), (2, None), (3, ""), (4, "plain")])).collect()}
    assert rows[1]["text"] == "é [EMAIL] x [PHONE]"
    assert (rows[2]["text"], rows[3]["text"], rows[4]["text"]) == (None, "", "plain")
    assert pii.redacted(docs([])).count() == 0


def test_query(spark, docs, tmp_path):
    texts = [*TEXTS, "a@b.cd"]
    docs([*enumerate(texts), (99, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in pii.op4_boosted_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert rows[i]["base_sha256"] == digest(text)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
    assert rows[99]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[99]["spans"] == ""


def test_no_python_in_plan(spark, docs):
    plan = pii.with_spans(docs([(1, "a@b.cd")]))._jdf.queryExecution().executedPlan().toString()
    assert not pytest.importorskip("re").search("Python|Pandas|Arrow", plan)
    assert F is not None

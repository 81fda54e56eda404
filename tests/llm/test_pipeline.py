"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from fathom.llm import bpe, mixing, quality
from tests.llm.test_minhash import brute

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("mo", "ta", "ri", "su", "le") for b in ("na", "ko", "ver", "din", "sal", "por")]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = []
    for i in range(240):
        t = text(rng.randint(30, 90))
        if i % 4 == 0:
            t = " ".join(w + "$$$" for w in t.split()) if i % 8 else t.upper() + "!!"
        elif i % 5 == 0:
            t = rows[i - 3 if (i - 3) % 4 else i - 1][1]  # a copy of a good text
        elif i % 7 == 0:
            t += f" write to p{i}.x@mail.example.com or +1 (743) 555-{1000 + i}"
        rows.append((i, t, "en", f"src{i % 25}", len(t)))
    rows += [(900, None, "en", "src1", None), (901, "", None, None, 0)]
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_filter", "near_duplicates", "redaction", "source_mix", "tokens"]
    step = lambda name, d: stages[name](spark, d, folder)
    table = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]

    good = step("quality_filter", docs).cache()
    assert good.columns == columns
    kept = {i for i, _ in table(good)}
    assert sum(i % 4 != 0 for i in kept if i < 240) / sum(i < 240 for i in kept) > 0.97 and len([i for i in kept if i < 240]) >= 170
    assert quality.op3_subword_quality(spark, folder).where("predicted = 1").select("doc_id").distinct().count() == len(kept)

    single = step("near_duplicates", good).cache()
    assert single.columns == columns
    want = brute(table(good), 5, 80, 100)
    assert sorted(i for i, _ in table(single)) == sorted(k for k, v in want.items() if v[1] == k)

    clean = step("redaction", single).cache()
    assert clean.columns == columns
    before = dict(table(single))
    for i, t in table(clean):
        plain = before[i] and re.sub(r"\+[0-9][ ().0-9-]+[0-9]", "[PHONE]", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", before[i]))
        assert t == plain
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.collect() if r["n_chars"] is not None)

    mix = step("source_mix", clean).cache()
    assert mix.columns == columns
    rows = clean.select("doc_id", "source").collect()
    per = Counter(r["source"] for r in rows)
    expected = Counter()
    for r in rows:
        rate = mixing.WEIGHTS[r["source"]] * len(rows) / per[r["source"]] if r["source"] in mixing.WEIGHTS else 1.0
        u = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        total = p
        while u >= total:
            n += 1
            p *= rate / n
            total += p
        expected[r["doc_id"]] += n
    assert Counter(i for i, _ in table(mix)) == +expected

    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    texts = dict(table(mix))
    out = step("tokens", mix).collect()
    assert Counter(r["doc_id"] for r in out) == +expected
    for r in out:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

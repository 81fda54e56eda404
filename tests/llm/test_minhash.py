"""Near duplicates against brute force over full sets; sketch properties; edge cases."""

import random
import re

import numpy as np
import pyarrow as pa

from fathom.llm import minhash
from fathom.llm.common import utf8

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, share, whole):
    sets = [brute_set(t, width) for _, t in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and whole * common >= share * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                head[max(a, b)] = min(a, b)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    return {k: (len(sets[i]), k if k is None else min(groups[root(i)])) for i, (k, _) in enumerate(rows)}


def corpus(seed, n, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, base = [], [rng.choices(vocabulary, k=rng.randint(20, 120)) for _ in range(6)]
    for i in range(n):
        words = list(rng.choice(base)) if rng.random() < 0.8 else rng.choices(vocabulary, k=rng.randint(1, 60))
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


def check(docs, rows, width, least):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows), width, least).collect()}
    want = brute(rows, width, *least)
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[2] == (k is None or k == v[1]) for k, v in got.items())


def test_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # clusters of several blocks
    check(docs, corpus(1, 150, 6), 3, (85, 100))
    check(docs, corpus(2, 120, 4), 5, (80, 100))
    monkeypatch.setattr(minhash, "MOST_BLOCKS", 1)  # heads first, then buckets
    check(docs, corpus(3, 150, 5), 3, (85, 100))


def test_edge_cases(docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "oNE TWO"), (6, "one"), (7, "one two three"), (8, "ONE two"), (9, "É é"), (10, "é é"), (None, "one two three"), (11, "a " * 5000), (12, "a a a")]
    check(docs, rows, 3, (85, 100))


def test_repeated_rows_and_empty_table(docs):
    got = minhash.near_duplicates(docs([(5, "a b c d"), (5, "a b c d"), (2, "a b c d")]), 3, (85, 100)).collect()
    assert [r["component_id"] for r in got] == [2, 2, 2] and sum(r["kept"] for r in got) == 1
    assert minhash.near_duplicates(docs([]), 3, (85, 100)).count() == 0


def test_deduplicated(docs):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (7, None), (8, "x"), (None, "a b c d e f")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in minhash.deduplicated(docs(rows)).collect())
    assert [g[0] for g in got] == [0, 1, 7, 8]


def test_an_id_with_two_texts_leaves_one(docs):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h i"), (4, "a b c d e f g h"), (9, "z")]
    got = minhash.deduplicated(docs(rows), 3, (80, 100)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 9]


def sets_of(texts, width):
    data, offsets = utf8(pa.array(texts))
    return minhash.shingle_sets(data, offsets, width)


def test_sketches_merge_and_estimate():
    rng = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    for overlap in (0.2, 0.6, 0.9):
        a = rng.sample(words, 800)
        b = a[: int(800 * overlap)] + rng.sample([w for w in words if w not in set(a)], 800 - int(800 * overlap))
        hashes, cuts = sets_of([" ".join(sorted(a)), " ".join(sorted(b)), " ".join(sorted(set(a) | set(b)))], 1)
        r = minhash.registers(hashes, cuts)
        assert (np.maximum(r[0], r[1]) == r[2]).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(minhash.similarity(r[:1], r[1:2], np.array([800.0]), np.array([800.0]))[0] - true) < 0.15

import random

import numpy as np

from spanforge.llm import minhash
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import smallest_reachable, table

P = minhash.Params()


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=2, percent=80):
    """{position: component} by comparing all pairs; links join documents, copies too."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    low = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return [(rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows))]


def check(spark, df, rows, p=P):
    got = minhash.near_duplicates(df, params=p).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=order) == sorted(brute(rows, p.words, p.percent), key=order)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_near_copies(spark, make_docs):
    """Long chains whose ends are unlike: no link of the chain may be lost."""
    rnd = random.Random(8)
    rows, key = [], 0
    for group in range(6):
        words = [f"w{group}x{rnd.randrange(10_000)}" for _ in range(60)]
        for _ in range(30):
            words[rnd.randrange(60)] = f"n{rnd.randrange(10**6)}"
            rows.append((key, " ".join(words)))
            key += 1
    rnd.shuffle(rows)
    check(spark, make_docs(rows), rows)


def test_odd_rows(spark, odd, none):
    from llm.conftest import ODD

    check(spark, odd, ODD)
    assert minhash.near_duplicates(none).count() == 0


def test_missing_keys_are_linked_too(spark, make_docs):
    base = [f"k{i}" for i in range(40)]
    rows = [(None, " ".join(base)), (None, " ".join([*base, "x"])), (None, "other words here"), (4, " ".join(["y", *base])), (9, "lone text")]
    check(spark, make_docs(rows), rows)


def test_five_words_and_unlike_texts(spark, make_docs):
    rows = [(i, " ".join(f"t{(i * 31 + j) % 997}" for j in range(40))) for i in range(50)] + [(99, "a b"), (100, "A b"), (101, "a B c")]
    check(spark, make_docs(rows), rows, minhash.Params(words=5))


def test_min_max_values_estimate_resemblance():
    rnd = np.random.default_rng(4)
    hits, (key, odd) = [], minhash.permutations(P)
    for _ in range(30):
        base = rnd.integers(0, 1 << 63, 900, np.uint64)
        a, b = base[:800], base[100:]  # 700 of 900 common
        va, vb = (a ^ key) * odd, (b ^ key) * odd
        hits.append(np.concatenate([va.min(1) == vb.min(1), va.max(1) == vb.max(1)]).mean())
    assert abs(np.mean(hits) - 700 / 900) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in smallest_reachable(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 200: 200, 201: 200}
    assert smallest_reachable(df.filter("false"), "a", "b").count() == 0


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op7_minhash"](spark, sf).collect())
    assert got == sorted(brute(rows))


def test_rejected_candidates_hide_nothing(spark, make_docs, monkeypatch):
    """Nearly all tokens collide, so most candidates of the last step are false."""
    monkeypatch.setattr(minhash, "SHORT", 11)
    rnd = random.Random(21)
    rows, key = [], 0
    for group in range(5):
        words = [f"w{x}" for x in rnd.sample(range(300), 60)]
        for _ in range(16):
            words[rnd.randrange(60)] = f"w{rnd.randrange(300)}"
            rows.append((key, " ".join(words)))
            key += 1
    check(spark, make_docs(rows), rows, minhash.Params(star_rounds=0))


def test_long_texts_of_one_bucket_are_dealt_to_blocks(spark, make_docs):
    rnd = random.Random(22)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for key in range(36):
        if key % 3:
            words[rnd.randrange(900)] = f"n{key}"
        else:
            words = [w if rnd.random() < 0.93 else f"m{key}x{i}" for i, w in enumerate(words)]
        rows.append((key, " ".join(words)))
    check(spark, make_docs(rows), rows, minhash.Params(star_rounds=0, block_tokens=5_000))
    check(spark, make_docs(rows), rows, minhash.Params(block=2))

"""Gram and subsequence overlap against plain counting."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from spanforge.operators import metrics as mt


def words(rnd, n):
    return " ".join(rnd.choice(["the", "cat", "sat", "on", "mat", "A", "a,", "x9"]) for _ in range(n))


@pytest.fixture
def texts(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, rnd.randrange(0, 30)), words(rnd, rnd.randrange(0, 30))) for i in range(200)]
    rows += [(200, None, "the cat"), (201, "the", None), (202, "", ""), (203, "the cat " * 400, "cat the " * 300)]
    return rows, spark.createDataFrame(rows, "k long, candidate string, reference string").repartition(3)


@pytest.mark.parametrize("tokens", [50, 2_000_000])
def test_gram_overlap(texts, monkeypatch, tokens):
    monkeypatch.setattr(mt, "TOKENS", tokens)
    rows, df = texts
    got = {(r.k, x.n): (x.overlap, x.n_cand, x.n_ref) for r in mt.gram_overlap(df, ["k"], (1, 2, 4), mt.plain_tokens).collect() for x in r.overlaps}
    assert len(got) == 3 * len(rows)
    for k, *both in rows:
        for n in (1, 2, 4):
            c, r = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in ((x or "").lower().split() for x in both))
            assert got[k, n] == (sum((c & r).values()), sum(c.values()), sum(r.values())), (k, n)


def test_rouge_l(texts):
    rows, df = texts
    got = {r.k: r.lcs for r in mt.rouge_l(df, ["k"]).collect()}
    for k, c, r in rows[:200]:
        a, b = (x.lower().replace(",", "").split() for x in (c, r))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert got[k] == table[-1][-1]
    assert got[200] == got[201] == got[202] == 0 and got[203] == 600


def test_nothing_is_shuffled(texts):
    for made in (mt.rouge_n(texts[1], ["k"]), mt.rouge_l(texts[1], ["k"]), mt.bleu4(texts[1], ["k"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == texts[1]._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_memory_of_a_batch_does_not_follow_its_rows():
    import tracemalloc

    tokens = [f"w{i % 97}" for i in range(90)]
    sides = [pa.array([tokens] * 10_000, pa.list_(pa.string()))] * 2
    batch = pa.RecordBatch.from_arrays(sides, names=["candidate", "reference"])
    tracemalloc.start()
    for part in mt._token_slices(batch):
        mt.count_overlaps(part, (1, 2, 3, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20

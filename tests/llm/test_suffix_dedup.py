import hashlib
import random

import numpy as np
import pytest

from spanforge.llm import suffix_dedup as sd
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table

LAST = 1 << 62


def brute(rows, length):
    first = {}
    data = [((LAST if i is None else i), (t or "").encode()) for i, t in rows]
    for i, d in data:
        for k in range(len(d) - length + 1):
            w = d[k : k + length]
            first[w] = min(first.get(w, LAST), i)
    out = []
    for (key, _), (i, d) in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 2, bool)
        for k in range(len(d) - length + 1):
            if first[d[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[1 : len(d) + 1]])
        out.append((key, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, p=None):
    return sorted(map(tuple, sd.remove_repeats(df, params=p).collect()), key=str)


def test_random_texts(spark, make_docs):
    rnd = random.Random(6)
    for trial in range(3):
        length = (20, 50, 50)[trial]
        pool = ["".join(rnd.choice("abcé \x00") for _ in range(rnd.randrange(0, 260))) for _ in range(5)]
        rows = []
        for i in range(40):
            parts = [rnd.choice(pool)[rnd.randrange(0, 40) : rnd.randrange(60, 260)] if rnd.random() < 0.6 else "".join(rnd.choice("xyz") for _ in range(rnd.randrange(0, 70))) for _ in range(rnd.randrange(0, 5))]
            rows.append((i * 2, "".join(parts)))
        rows += [rows[3], (None, rows[5][1]), (1, rows[6][1])]
        p = sd.Params(length=length, gram=8 if length == 20 else 16, array_bytes=(400, 4 << 20, 900)[trial], candidate_bytes=3_000, shard_bytes=2_000, portion=1_500)
        assert got(make_docs(rows).repartition(3), p) == brute(rows, length)


def test_odd_rows(spark, odd, none):
    from llm.conftest import ODD

    rows = [(i, t[:900] if t else t) for i, t in ODD]
    df = odd.selectExpr("doc_id", "substring(text, 1, 900) AS text", "node")
    assert got(df) == brute(rows, 50)
    assert sd.remove_repeats(odd).count() == 11
    assert sd.remove_repeats(none).count() == 0


def test_kept_text_has_whole_characters(spark, make_docs):
    shared = "é" * 40
    rows = [(1, "a" + shared + "b"), (2, "c" + shared + "d")]
    kept = {r["doc_id"]: r["kept_text"] for r in sd.remove_repeats(make_docs(rows), kept_text=True).collect()}
    assert kept == {1: rows[0][1], 2: "cd"}
    assert sd._whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)] and sd._whole_characters("aéb".encode(), [(2, 3)]) == []


@pytest.mark.parametrize("lanes", [1, 3, 100])
def test_prefix_lengths_of_texts_with_long_repeats(lanes):
    rng = np.random.default_rng(lanes)
    for _ in range(30):
        text = rng.integers(97, 99, int(rng.integers(1, 200))).astype(np.uint8)
        text = np.concatenate([text, text[: int(rng.integers(0, 150))], np.full(int(rng.integers(0, 200)), 97, np.uint8), text])
        order, head = sd.suffix_array(text, 20)
        lcp = sd.common_prefixes(text, order, head, 20, lanes)
        for k in range(1, len(order)):
            a, b = bytes(text[order[k - 1] :][:20]), bytes(text[order[k] :][:20])
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_many_texts_without_a_key_do_not_meet(spark, make_docs):
    rows = [(None, f"{i} " + "a passage that is held by all of these texts and is longer than fifty bytes" + f" {i}") for i in range(400)]
    df = make_docs(rows)
    out = sd.remove_repeats(df)
    assert out.count() == 400 and out.filter("n_removed > 0").count() == 0  # among equal keys none is smaller
    joins = [m for m in _row_counts(out) if m is not None]
    assert joins and max(joins) <= 2 * 400


def _row_counts(df):
    """Output rows of the joins of a plan that has run."""
    df.write.format("noop").mode("overwrite").save()
    execution = df._jdf.queryExecution()
    df._jdf.rdd().count()
    found, stack = [], [execution.executedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_arrays_and_merging():
    text = np.frombuffer(b"banana bandana banana", np.uint8)
    order, head = sd.suffix_array(text, 64)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: bytes(text[i:]))
    lcp = sd.common_prefixes(text, order, head, 50)
    for k in range(1, len(order)):
        a, b = bytes(text[order[k - 1] :]), bytes(text[order[k] :])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n
    a = (np.array([b"aa", b"cc"]), np.array([5, 6]))
    b = (np.array([b"bb", b"cc", b"dd"]), np.array([1, 2, 3]))
    keys, least = sd.merge_classes(a, b)
    assert keys.tolist() == [b"aa", b"bb", b"cc", b"dd"] and least.tolist() == [5, 1, 2, 3]


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op9_suffix_dedup"](spark, sf).collect()), key=str) == brute(rows, 50)

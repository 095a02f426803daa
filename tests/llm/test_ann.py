import math

import numpy as np

from spanforge.llm import ann
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table


def brute(rows, asked, k=5):
    use = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in use:
        if q in asked:
            near = [(-float(v @ u / math.sqrt((v @ v) * (u @ u))), i) for i, u in use if i != q and len(u) == len(v)]
            out[q] = sorted(near)[:k]
    return out


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows, {i for i, _ in rows if i % 50 == 0})
    got = {}
    for r in QUERIES["op8_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    exact = {(q, i): -s for q, near in want.items() for s, i in near}
    hits = sum((q, i) in exact for q, near in got.items() for i, _ in near)
    assert hits / len(exact) >= 0.97
    assert all(abs(s - exact[q, i]) < 1e-12 for q, near in got.items() for i, s in near if (q, i) in exact)


def test_shards_ties_and_unusable_rows(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.standard_normal(8)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 420)]  # a hot vector
    rows += [(500, None), (501, [0.0] * 8), (502, [math.nan] + [1.0] * 7), (503, [math.inf] * 8), (None, [1.0] * 8), (504, [1.0, 2.0]), (505, [1.0, 2.1]), (506, []), (300, [1.0] * 8), (507, [1e300, -1e300] * 4)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, score double")
    asked = {0, 50, 100, 300, 350, 500, 501, 504}
    p = ann.Params(shard_rows=64, block_queries=3)
    got = {}
    for r in ann.search(df, df.filter(df.vec_id.isin(*asked)).dropDuplicates(["vec_id"]), params=p).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"]))
    assert set(got) == {0, 50, 100, 300, 350, 504}
    assert [i for i, _ in got[350]] == [300, 300, 301, 302, 303] and [n for _, n in got[350]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[300]] == [301, 302, 303, 304, 305]
    assert got[504] == [(505, 1)]
    want = brute(rows[:300] + rows[300:420], {0, 50, 100})
    hits = sum(i in {x for _, x in want[q]} for q in (0, 50, 100) for i, _ in got[q])
    assert hits >= 13
    assert ann.search(df.filter("false"), df.filter("false")).count() == 0


def test_everything_is_found_when_there_is_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.search(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(1, 3, 0.0), (1, 2, -1.0), (2, 3, 0.0), (2, 1, -1.0), (3, 1, 0.0), (3, 2, 0.0)]

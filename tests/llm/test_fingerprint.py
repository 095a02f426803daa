import hashlib

from pyspark.sql import functions as F

from spanforge.llm import fingerprint as fp
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table


def words_of(text):
    return [w for w in text.lower().split(" ")] if text else []


def exact(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query_follows_brute_force(spark, sf):
    rows = sorted(table(spark, sf, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op1_fingerprint"](spark, sf).collect()}
    assert len(got) == len(rows)
    error = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n, q = len(text), len(text) // 4
        edited = text[: n - q] + after[:q]
        assert got[i]["n_chars"] == n
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        error.append(abs(got[i]["near_edited"] - exact(text, edited)))
        assert abs(got[i]["near_next"] - exact(text, after)) < 0.2
    assert max(error) < 0.2 and sum(error) / len(error) < 0.03


def test_equal_texts_and_small_slabs(spark, sf):
    docs = table(spark, sf, "documents")
    one = fp.fingerprint_documents(docs).select("doc_id", "edited", "sketch")
    many = fp.fingerprint_documents(docs, slab_rows=7).select("doc_id", "edited", "sketch")
    assert sorted(one.collect()) == sorted(many.collect())


def test_odd_rows(spark, odd, none):
    got = fp.fingerprint_documents(odd, slab_rows=2).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[5][0]["sketch"] == by[5][1]["sketch"]
    assert [r["n_chars"] for r in by[2] + by[3]] == [0, 0] and by[4][0]["sketch"] == [] == by[3][0]["sketch"]
    assert by[1][0]["sketch"] == by[7][0]["sketch"] and len(by[6][0]["sketch"]) == 1
    assert fp.fingerprint_documents(none).count() == 0


def test_single_row_is_its_own_next(spark, make_docs):
    (row,) = fp.fingerprint_documents(make_docs([(4, "abcdefgh")])).collect()
    assert row["edited"] == "abcdefab" and row["sketch"] == row["next_sketch"]


def test_merge_containment_and_counts(spark):
    text = " ".join(f"w{i}" for i in range(2_000))
    half = " ".join(f"w{i}" for i in range(1_000))
    df = spark.createDataFrame([(1, text, half)], "k int, a string, b string")
    df = df.select("k", fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    row = df.select(
        fp.containment(F.col("b"), F.col("a")).alias("inside"),
        fp.containment(F.col("a"), F.col("b")).alias("half"),
        fp.distinct_shingles(F.col("a")).alias("n"),
    ).first()
    assert row["inside"] > 0.75 and abs(row["half"] - 0.5) < 0.2 and abs(row["n"] - 1996) < 600
    parts = df.select("k", F.col("a").alias("sketch")).unionByName(df.select("k", F.col("b").alias("sketch")))
    parts = parts.unionByName(spark.createDataFrame([(1, None), (2, [])], "k int, sketch array<bigint>"))
    merged = {r["k"]: r["sketch"] for r in fp.merge_sketches(parts, ["k"]).collect()}
    assert merged == {1: df.select(fp.union_sketch(F.col("a"), F.col("b"))).first()[0]}

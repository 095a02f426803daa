import pytest

import corpus_pipeline as cp
from spanforge.llm import minhash, pii
from spanforge.llm.shared import table
from llm.test_minhash import brute as components
from llm.test_packing import PATH, check, library  # noqa: F401
from llm.test_suffix_dedup import LAST

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage on the written result of the one before."""
    docs, out = table(spark, SF, "documents"), [table(spark, SF, "documents")]
    for name, stage in cp.STAGES:
        place = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(place)
        docs = spark.read.parquet(place)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(d.columns == list(cp.COLUMNS) for d in steps[1:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in kept for i in clean) / len(clean) > 0.98
    toxic = [i for i, y in labels.items() if y]
    assert sum(i not in kept for i in toxic) / len(toxic) > 0.6


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    want = [(i, t) for (i, t), (_, _, c) in zip(before, components(before, 5), strict=True) if i == c]
    assert rows(steps[2]) == sorted(want, key=str)


def test_repeats_are_cut(steps):
    before, length = rows(steps[2]), 50
    first = {}
    for i, t in before:
        d = t.encode()
        for k in range(len(d) - length + 1):
            first[d[k : k + length]] = min(first.get(d[k : k + length], LAST), i)
    want = []
    for i, t in before:
        d = t.encode()
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if first[d[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        if out or not d:
            want.append((i, "".join(out)))
    assert rows(steps[3]) == sorted(want, key=str)


def test_personal_data_is_masked(steps):
    assert rows(steps[4]) == sorted(((i, pii.mask(t, pii.find_spans(t))) for i, t in rows(steps[3])), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect())


def test_packing(steps, library):  # noqa: F811
    check(library, rows(steps[4]), steps[5].collect())


def test_run_gives_the_same(spark, steps):
    short = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert short(cp.run(spark, SF)) == short(steps[5])


def test_odd_rows(spark, odd, none, tmp_path):
    for k, docs in enumerate((odd, none)):
        for name, stage in cp.STAGES:
            place = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, SF).write.parquet(place)
            docs = spark.read.parquet(place)
        assert docs.count() == (0 if k else docs.count())
    assert minhash.near_duplicates(none).count() == 0

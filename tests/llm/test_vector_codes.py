import hashlib
import math

import numpy as np
import pytest

from spanforge.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, error string, _part int"


@pytest.mark.parametrize("width", [0, 1, 3, 5, 8])
@pytest.mark.parametrize("most", [3, 5_000, 1 << 40])
def test_nearest_entries_are_exact(width, most):
    rng = np.random.default_rng(width)
    parts, entries = rng.integers(-most, most, (400, width)), rng.integers(-most, most, (16, width))
    entries[9] = entries[4]
    index, far, work = vc.nearest_entries(parts, entries)
    d = parts[:, None, :].astype(object) - entries[None].astype(object)
    full = (d * d).sum(axis=2) if width else np.zeros((400, 16), object)
    assert index.tolist() == full.argmin(axis=1).tolist() and far.tolist() == full.min(axis=1).tolist()
    assert work <= 400 * 17 * max(1, 1 << max(0, width - 1).bit_length())


def test_entries_go_early():
    rng = np.random.default_rng(5)
    entries = rng.integers(-4_000, 4_000, (16, 1)) + rng.integers(-200, 200, (16, 64))  # most of it lies in the lowest sequency
    parts = entries[rng.integers(0, 16, 2_000)] + rng.integers(-100, 100, (2_000, 64))
    assert vc.nearest_entries(parts, entries)[2] < 0.5 * 2_000 * 16 * 64


def test_rows_are_in_sequency_order():
    for width in (1, 2, 8, 32):
        h = vc.sequency_order(width)
        assert (h @ h.T == width * np.eye(width)).all()
        assert [(row[1:] != row[:-1]).sum() for row in h] == list(range(width))


def brute(rows, entries=16, rounds=6, parts=8):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab, *_ in rows if fine(v)]
    width = max(len(v) for _, v, _ in kept)
    size = -(-width // parts)
    kept = [(i, v + [0] * (size * parts - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, v, _ in first] for p in range(parts)]

    def near(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            own = [v[p * size : (p + 1) * size] for _, v, _ in kept]
            codes = [near(p, x)[0] for x in own]
            for e in set(codes):
                of = [x for x, c in zip(own, codes) if c == e]
                new[p][e] = [sum(col) // len(of) for col in zip(*of)]
        books = new
    out = []
    for i, v, lab in kept:
        found = [near(p, v[p * size : (p + 1) * size]) for p in range(parts)]
        out.append((i, "".join(f"{c:02x}" for c, _ in found), sum(d for _, d in found), lab))
    totals = {}
    for *_, error, lab in out:
        totals[lab] = totals.get(lab, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[lab], digest) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("case", ["usual", "few", "ragged", "large"])
def test_against_plain_python(spark, case, monkeypatch):
    rng = np.random.default_rng(7)
    n, width = (9, 16) if case == "few" else (150, 24)
    scale = 1e4 if case == "large" else 1.0
    rows = [[int(i), (rng.normal(size=width) * scale).astype(np.float32).tolist(), int(i) % 3 or None, "x", 1] for i in rng.permutation(n)]
    rows[3][0] = rows[4][0] = None
    rows[5][0] = rows[6][0]
    rows[7][1] = list(rows[8][1])
    rows += [[1000, None, 1, "x", 1], [1001, [1.0, None], 1, "x", 1], [1002, [float("nan")] * width, 1, "x", 1], [1003, [float("inf")] * width, None, "x", 1]]
    if case == "ragged":
        rows[0][1], rows[1][1], rows[2][1] = [], [0.5], rows[2][1][:20]
    monkeypatch.setattr(vc, "BLOCK", 17)
    if case == "ragged":
        monkeypatch.setattr(vc, "fits_broadcast", lambda side: False)  # the salted join
    got = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vc.compress(none).count() == 0
    only = spark.createDataFrame([[1, None, 1, "x", 1], [2, [], None, "x", 1]], SCHEMA)
    assert [(r["vec_id"], r["code"], r["error"]) for r in vc.compress(only).collect()] == [(2, "00" * 8, 0)]

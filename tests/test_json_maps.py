"""Keyed map files split at their entries by several tasks."""

import json
import random

import numpy as np
import pytest

from spanforge.sources import json_maps
from spanforge.sources.records import parse_nested_docs


@pytest.fixture
def ranges(spark):
    """Read files in ranges of so many bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, before)


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def found(df):
    return sorted((r["video_id"], json.loads(r["doc"])) for r in df.collect())


def awkward(rnd, n):
    signs = ['"', "\\", "{", "}", "[", "]", ",", ":", "é", "中", "\n", "a", " ", '\\"', '"}', "\\\\", "x" * 30]
    text = lambda: "".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 40)))
    return {f"v_{i}{text()}": {"frames": [{"d": text(), "n": [1, {"x": text()}]}], "t": text(), "e": {}} for i in range(n)}


@pytest.mark.parametrize("size", [40, 1_000, 20_000, 128 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_one_object_by_ranges(spark, ranges, tmp_path, size, indent):
    want = awkward(random.Random(size), 60)
    path = write(tmp_path / "map.json", json.dumps(want, indent=indent, ensure_ascii=False))
    ranges(size)
    assert found(json_maps.read_json_map(spark, path, "d")) == sorted(want.items())


def test_many_megabytes_by_several_tasks(spark, ranges, tmp_path, monkeypatch):
    rnd = random.Random(5)
    want = {f"v_{i}": {"text": f'{i} "}}{{" \\ ' * rnd.randrange(1, 400), "k": i} for i in range(6_000)}
    want["v_long"] = {"text": "no bracket " * 200_000, "k": -1}  # one entry of many ranges
    path = write(tmp_path / "map.json", json.dumps(want))
    ranges(500_000)
    assert json_maps._ranges(spark, path).rdd.getNumPartitions() > 20
    monkeypatch.setattr(json_maps, "fits_broadcast", lambda side: False)  # start states by a shuffle
    rows = json_maps.read_json_map(spark, path, "d").collect()
    assert len(rows) == len(want) and all(json.loads(r["doc"]) == want[r["video_id"]] for r in rows)


@pytest.mark.parametrize("size", [60, 128 << 20])
def test_several_objects_and_files(spark, ranges, tmp_path, size):
    rnd, want = random.Random(7), []
    (tmp_path / "maps").mkdir()
    for name, end in (("a.json", "\n"), ("b.json", ""), ("c.json", " \n\n")):
        maps = [awkward(rnd, n) for n in (3, 0, 5, 1)]
        want += [e for m in maps for e in m.items()]
        write(tmp_path / "maps" / name, "\n".join(json.dumps(m) for m in maps) + end)
    write(tmp_path / "maps" / "empty.json", "")
    ranges(size)
    got = json_maps.read_json_map(spark, str(tmp_path / "maps"), "d")
    assert found(got) == sorted(want, key=lambda e: (e[0], json.dumps(e[1])))
    assert {r["dataset"] for r in got.collect()} == {"d"}


@pytest.mark.parametrize(
    "text",
    ['{"a": {"x": 1}', '{"a": {"x": 1}, "b": {"y": "2}', '{"a": {"x": 1}} tail', "[1, 2]", '{"a": {"x": 1}}}', '{"a": {"x": 1}}\n{"b": ', '{"a": {"x": [1}]}, 5}'],
)
@pytest.mark.parametrize("size", [8, 128 << 20])
def test_broken_files_raise(spark, ranges, tmp_path, text, size):
    ranges(size)
    with pytest.raises(Exception):
        json_maps.read_json_map(spark, write(tmp_path / "map.json", text), "d").collect()


def test_values_of_any_kind(spark, tmp_path):
    path = write(tmp_path / "map.json", '{ "a" : 1 , "b":"x,{y}", "c":[1,{"d":2}],"a":{"z": null} }')
    rows = json_maps.read_json_map(spark, path, "d").collect()
    assert sorted((r["video_id"], r["doc"]) for r in rows) == [("a", "1"), ("a", '{"z":null}'), ("b", "x,{y}"), ("c", '[1,{"d":2}]')]


def test_scan_functions_compose():
    rnd = random.Random(9)
    for _ in range(300):
        data = np.frombuffer("".join(rnd.choice('"\\{}[],a') for _ in range(rnd.randrange(1, 40))).encode() + b"}", np.uint8)
        inside, escaped, depth = False, False, 0
        for start in (False, True):
            inside, escaped, depth = start, False, 0
            for c in data.tobytes().decode():
                if escaped and c in '"\\':
                    escaped = False
                    continue
                escaped = c == "\\"
                if escaped:
                    continue
                if c == '"':
                    inside = not inside
                elif not inside:
                    depth += (c in "{[") - (c in "}]")
            _, change, end = json_maps.scan(data, start)
            assert (int(change.sum()), end) == (depth, inside)


def test_exploded_values_of_entries_across_ranges(spark, ranges, tmp_path):
    want = {f"v_{i}": {"frames": [{"frame_id": j, "description": "x" * j} for j in range(6)]} for i in range(40)}
    path = write(tmp_path / "map.json", json.dumps(want))
    ranges(100)
    frames = parse_nested_docs(json_maps.read_json_map(spark, path, "d"))["frames"]
    got = sorted((r.video_id, r.frame_id, r.description) for r in frames.collect())
    assert got == sorted((v, f["frame_id"], f["description"]) for v, d in want.items() for f in d["frames"])

"""Removal of long strings that earlier documents hold: candidates by minimizers, suffix arrays per shard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import give_back

# Odd constants of 64-bit mixing.
C1, C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Params:
    """Matches have ``length`` bytes. ``gram`` bytes form a minimizer candidate: a power of two below ``length``."""

    length: int = 50
    gram: int = 16
    candidate_bytes: int = 64 << 20  # text whose minimizers meet in one task
    shard_bytes: int = 8 << 20  # text whose shared strings meet in one task
    part_bytes: int = 1 << 20  # text whose shared minimizers are sorted by text in one task
    array_bytes: int = 4 << 20  # text of one suffix array
    portion: int = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * GOLDEN
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, text number, first start, last start) of runs of neighbouring windows with one minimizer.

    A window is a string of ``length`` bytes inside a text; its minimizer is the smallest hash of its grams, so equal
    windows have equal minimizers wherever they stand.
    """
    empty = (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if total < p.length:
        return empty
    with np.errstate(over="ignore"):
        h = _mix((np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)) * C1)
        size = 1
        while size < p.gram:
            h = _mix(h[:-size] * C2 + h[size:])
            size *= 2
    m = _sliding_min(h, p.length - p.gram + 1) >> np.uint64(16)  # 48 bits
    n = len(m)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:n] == owner[p.length - 1 : p.length - 1 + n]
    same = np.zeros(n, bool)
    same[1:] = (m[1:] == m[:-1]) & (owner[1:n] == owner[: n - 1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & ~same)
    last = np.flatnonzero(inside & ~np.append(same[1:], False))
    begin = np.cumsum(sizes) - sizes
    who = owner[first]
    return m[first], who, first - begin[who], last - begin[who]


def _pack48(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack48(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel().astype(np.uint64)


def _bucket(m: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((_mix(m * C1) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _portions(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about ``limit`` bytes."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        used = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, used + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def minimizer_blobs(texts: DataFrame, buckets: int, p: Params) -> DataFrame:
    """(bucket, ids, nodes, counts, data): the distinct minimizers of texts (id, node, data), some hundred texts to a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 2, p.portion):
                ids, nodes = part.column(0).to_numpy(), part.column(1).to_numpy()
                m, who, _, _ = runs(part.column(2).to_pylist(), p)
                if not len(m):
                    continue
                order = np.lexsort((m, who))
                m, who = m[order], who[order]
                fresh = np.append(True, (m[1:] != m[:-1]) | (who[1:] != who[:-1]))
                m, who = m[fresh], who[fresh]
                place = _bucket(m, buckets)
                order = np.argsort(place, kind="stable")
                m, who, place = m[order], who[order], place[order]
                found, at = np.unique(place, return_index=True)
                out: dict[str, tuple[list, pa.DataType]] = {
                    "bucket": (found.tolist(), pa.int64()), **{name: ([], pa.binary()) for name in ("ids", "nodes", "counts", "data")}
                }
                for a, b in zip(at, [*at[1:], len(m)]):
                    own, counts = np.unique(who[a:b], return_counts=True)
                    out["ids"][0].append(ids[own].astype("<i8").tobytes())
                    out["nodes"][0].append(nodes[own].astype("<i8").tobytes())
                    out["counts"][0].append(counts.astype("<u4").tobytes())
                    out["data"][0].append(_pack48(m[a:b]).tobytes())
                yield _table(out)

    return texts.select("id", "node", "data").mapInArrow(work, "bucket long, ids binary, nodes binary, counts binary, data binary")


def shared_minimizers(blobs: DataFrame, parts: int) -> DataFrame:
    """(node, flags): for each text the minimizers that a text with another id holds too.

    What a bucket finds goes back in one row for each of ``parts`` groups of texts, where it is sorted by text.
    """

    def work(table: pa.Table) -> pa.Table:
        join = lambda name: b"".join(table[name].to_pylist())
        counts = np.frombuffer(join("counts"), "<u4")
        ids, nodes = (np.repeat(np.frombuffer(join(name), "<i8"), counts) for name in ("ids", "nodes"))
        m = _unpack48(join("data"))
        order = np.argsort(m, kind="stable")
        m, ids, nodes = m[order], ids[order], nodes[order]
        head = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
        keep = np.repeat(several, np.diff(np.append(head, len(m))))
        m, ids = m[keep], nodes[keep]
        part = _bucket(ids.astype(np.uint64), parts)
        order = np.argsort(part, kind="stable")
        data, ids, part = _pack48(m[order]), ids[order].astype("<i8"), part[order]
        own, at = np.unique(part, return_index=True)
        cuts = list(zip(at, [*at[1:], len(ids)]))
        give_back()
        columns = [pa.array(own, pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (ids, data))]
        return pa.table(columns, names=["part", "ids", "data"])

    def by_text(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<i8")
        data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8).reshape(-1, 6)
        order = np.argsort(ids, kind="stable")
        ids, data = ids[order], data[order]
        own, at = np.unique(ids, return_index=True)
        flags = [data[a:b].tobytes() for a, b in zip(at, [*at[1:], len(ids)])]
        return pa.table([pa.array(own, pa.int64()), pa.array(flags, pa.binary())], names=["node", "flags"])

    found = blobs.groupBy("bucket").applyInArrow(work, "part long, ids binary, data binary")
    return found.groupBy("part").applyInArrow(by_text, "node long, flags binary")


def snippet_blobs(texts: DataFrame, buckets: int, p: Params) -> DataFrame:
    """(bucket, runs, data): the strings around shared minimizers, of texts (id, data, node, flags)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 1, p.portion):
                ids, nodes = part.column(0).to_numpy(), part.column(2).to_numpy()
                texts = part.column(1).to_pylist()
                m, who, first, last = runs(texts, p)
                if not len(m):
                    continue
                flags = [_unpack48(f) for f in part.column(3).to_pylist()]
                cut = np.searchsorted(who, np.arange(len(texts) + 1))
                hit = np.zeros(len(m), bool)
                for k, f in enumerate(flags):
                    hit[cut[k] : cut[k + 1]] = np.isin(m[cut[k] : cut[k + 1]], f)
                m, who, first, last = m[hit], who[hit], first[hit], last[hit]
                place = _bucket(m, buckets)
                order = np.argsort(place, kind="stable")
                m, who, first, last, place = (x[order] for x in (m, who, first, last, place))
                found, at = np.unique(place, return_index=True)
                out: dict[str, tuple[list, pa.DataType]] = {"bucket": (found.tolist(), pa.int64()), "runs": ([], pa.binary()), "data": ([], pa.binary())}
                stops = last + p.length
                for a, b in zip(at, [*at[1:], len(m)]):
                    rows = np.column_stack([ids[who[a:b]], nodes[who[a:b]], first[a:b], stops[a:b] - first[a:b], m[a:b].astype(np.int64)])
                    out["runs"][0].append(rows.astype("<i8").tobytes())
                    out["data"][0].append(b"".join([texts[w][x:y] for w, x, y in zip(who[a:b].tolist(), first[a:b].tolist(), stops[a:b].tolist())]))
                yield _table(out)

    return texts.select("id", "data", "node", "flags").mapInArrow(work, "bucket long, runs binary, data binary")


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes, sorted by at least their first ``depth`` bytes; whether each differs there from the one before).

    Beyond the end stand zero bytes.

    Larsson-Sadakane refinement: after a sort by eight bytes, only groups of suffixes that are still equal are sorted again, by the
    rank of the suffix that begins where the compared part ends, which doubles that part.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    del key
    order = order.astype(np.int32)
    rank = np.zeros(n + 1, np.int32)  # the end of the text has rank 0
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1, dtype=np.int32), 0))
    known = 8
    while known < depth:
        alone = head & np.append(head[1:], True)
        open_ = np.flatnonzero(~alone).astype(np.int32)
        if not len(open_):
            break
        places = order[open_]
        both = rank[places].astype(np.int64) * (n + 1)
        both += rank[np.minimum(places + np.int32(known), n)]
        by = np.argsort(both)
        places, both = places[by], both[by]
        del by
        order[open_] = places
        fresh = np.append(True, both[1:] != both[:-1])
        del both
        head[open_] = fresh
        rank[places] = np.maximum.accumulate(np.where(fresh, open_ + 1, 0))
        known *= 2
    return order, head


def common_prefixes(text: np.ndarray, order: np.ndarray, head: np.ndarray, cap: int, lanes: int = 1 << 14) -> np.ndarray:
    """Length, up to ``cap``, of the common prefix of each suffix in ``order`` and the one before it (0 for the first).

    Kasai's method: the suffixes are met in the order of the text, and one byte less than the last length is known to agree
    already. The text is cut into lanes that are walked side by side, each with its own length; eight bytes are compared at a time. Suffixes that
    the sort did not tell apart (no ``head``) agree as far as asked; what follows one of them starts from nothing.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    alike = np.zeros(n, bool)
    alike[order] = ~head
    padded = np.concatenate([text, np.zeros(8 + cap, np.uint8)])
    word = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        word <<= np.uint64(8)
        word |= padded[j : j + len(word)]
    out = np.zeros(n, np.int32)
    width = -(-n // lanes)
    start = np.arange(0, n, width)
    carried = np.zeros(len(start), np.int64)
    for t in range(width):
        at = start + t
        if at[-1] >= n:
            at, carried = at[:-1], carried[: len(at) - 1]
        other = before[at].astype(np.int64)
        same = alike[at]
        length = np.where(same, cap, carried)
        open_ = np.flatnonzero(~same & (other >= 0))
        while len(open_):
            k = length[open_]
            a, b = at[open_] + k, other[open_] + k
            differ = word[a] ^ word[b]
            # Equal bytes at the front: those above the highest bit that differs.
            equal = np.where(differ == 0, 8, 8 - _bytes_of(differ))
            room = np.minimum(n - np.maximum(a, b), cap - k)
            length[open_] = k + np.minimum(equal, room)
            open_ = open_[(equal == 8) & (room > 8)]
        length[other < 0] = 0
        out[at] = length
        carried = np.where(same, 0, np.maximum(length - 1, 0))
    return out[order]


def _bytes_of(x: np.ndarray) -> np.ndarray:
    """How many bytes a positive 64-bit number has."""
    out = np.zeros(len(x), np.int64)
    for k in range(8):
        out += (x >> np.uint64(8 * k)) > 0
    return out


def window_classes(text: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each window, smallest owner of each class, a place of each class) of one array, classes in order of their bytes."""
    order, head = suffix_array(text, length)
    prefix = common_prefixes(text, order, head, length)
    wanted = np.full(len(text), -1, np.int32)
    wanted[starts] = np.arange(len(starts))
    window = wanted[order]
    del wanted
    chosen = np.flatnonzero(window >= 0)
    # Between two windows the least of the lengths on the way counts.
    same = np.minimum.reduceat(prefix, np.append(0, chosen[:-1] + 1)) >= length
    same[0] = False
    number = np.cumsum(~same) - 1
    out = np.empty(len(starts), np.int64)
    out[window[chosen]] = number
    first = np.flatnonzero(~same)
    return out, np.minimum.reduceat(owners[window[chosen]], first), order[chosen[first]]


def merge_classes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of two shards together: the windows of one are found in the other by binary search."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    at = np.searchsorted(a[0], b[0])
    hit = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    least = a[1].copy()
    least[at[hit]] = np.minimum(least[at[hit]], b[1][hit])
    new = ~hit
    return np.insert(a[0], at[new], b[0][new]), np.insert(least, at[new], b[1][new])


def earlier_windows(snippets: list[bytes], owners: np.ndarray, p: Params) -> Iterator[np.ndarray]:
    """For each of the distinct snippets which of its windows also stand in a snippet of a smaller owner."""
    sizes = np.array([len(s) for s in snippets], np.int64)
    shards, used = [[]], 0
    for k, size in enumerate(sizes.tolist()):
        if used and used + size > p.array_bytes:
            shards.append([])
            used = 0
        shards[-1].append(k)
        used += size
    arrays = []
    for shard in shards:
        text = np.frombuffer(b"".join([snippets[k] for k in shard]), np.uint8)
        own = sizes[shard]
        begin = np.cumsum(own) - own
        count = own - p.length + 1
        starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        arrays.append((text, count, *window_classes(text, starts, np.repeat(owners[shard], count), p.length)))
    least_of = [least for _, _, _, least, _ in arrays]
    if len(arrays) > 1:
        keyed = []
        for text, _, _, least, place in arrays:
            rows = text[place[:, None] + np.arange(p.length)]
            keyed.append((np.ascontiguousarray(rows).view(f"S{p.length}").ravel(), least))
        merged = keyed
        while len(merged) > 1:
            pairs = [merged[i : i + 2] for i in range(0, len(merged), 2)]
            merged = [merge_classes(*x) if len(x) == 2 else x[0] for x in pairs]
        least_of = [merged[0][1][np.searchsorted(merged[0][0], keys)] for keys, _ in keyed]
    for (_, count, number, _, _), least, shard in zip(arrays, least_of, shards, strict=True):
        earlier = least[number] < np.repeat(owners[shard], count)
        yield from np.split(earlier, np.cumsum(count)[:-1])


def removals(blobs: DataFrame, p: Params) -> DataFrame:
    """(id, node, spans): byte ranges of each text that are covered by windows of texts with smaller ids."""

    def work(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table["runs"].to_pylist()), "<i8").reshape(-1, 5)
        data = b"".join(table["data"].to_pylist())
        ids, nodes, first, size = (rows[:, k] for k in range(4))
        ends = np.cumsum(size)
        pieces = [data[e - s : e] for e, s in zip(ends.tolist(), size.tolist())]
        # Equal snippets are one; only the first of their texts has to look for its windows elsewhere.
        numbers: dict[bytes, int] = {}
        kind = np.array([numbers.setdefault(x, len(numbers)) for x in pieces], np.int64)
        owner = np.full(len(numbers), LAST_ID, np.int64)
        np.minimum.at(owner, kind, ids)
        m_of = np.zeros(len(numbers), np.int64)
        m_of[kind] = rows[:, 4]
        _, group, of_m = np.unique(m_of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(of_m[group] > 1)
        distinct = list(numbers)
        flagged = dict(zip(several.tolist(), earlier_windows([distinct[k] for k in several], owner[several], p))) if len(several) else {}
        out_id, out_tag, out_a, out_b = [], [], [], []
        later = ids > owner[kind]
        out_id.append(ids[later]), out_tag.append(nodes[later]), out_a.append(first[later]), out_b.append((first + size)[later])
        for k in np.flatnonzero(~later).tolist():
            flags = flagged.get(int(kind[k]))
            if flags is None or not flags.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            a, b = first[k] + edges[::2], first[k] + edges[1::2] - 1 + p.length
            out_id.append(np.full(len(a), ids[k])), out_tag.append(np.full(len(a), nodes[k])), out_a.append(a), out_b.append(b)
        i, t, a, b = (np.concatenate(x) for x in (out_id, out_tag, out_a, out_b))
        order = np.lexsort((a, t, i))
        i, t, a, b = i[order], t[order], a[order], b[order]
        head = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]))) if len(i) else np.empty(0, np.int64)
        both = np.column_stack([a, b]).astype("<i8")
        spans = [both[x:y].tobytes() for x, y in zip(head, [*head[1:], len(i)])]
        give_back()
        return pa.table([pa.array(i[head], pa.int64()), pa.array(t[head], pa.int64()), pa.array(spans, pa.binary())], names=["id", "node", "spans"])

    return blobs.groupBy("bucket").applyInArrow(work, "id long, node long, spans binary")


def _union(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges covered by spans."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    head = np.append(True, spans[1:, 0] > top[:-1])
    ends = top[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)]
    return list(zip(spans[head, 0].tolist(), ends.tolist(), strict=True))


def _without(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _whole_characters(data: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without characters of which they hold only a part."""
    out = []
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    params: Params | None = None,
    kept_text: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: key, the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256[, kept_text].

    A byte is removed if a string of ``length`` bytes that covers it also begins in a document with a smaller key. Texts
    are UTF-8 bytes, strings never cross documents, and all are judged on the input.

    Equal texts are one: of a text and its copies only the first is searched, the later ones go as a whole. A string that two
    texts share has the same minimizer in both, so the texts' minimizers are compared first; only the strings around
    shared ones move. Those with one minimizer meet in a shard, where suffix arrays sort their windows; a large shard has
    several arrays, merged by binary search. ``kept_text`` keeps characters whole that are removed only in part.

    Null and empty texts have no bytes. Among equal keys none is smaller; a null key is larger than every
    other. Repeated rows give equal rows. An empty table gives no rows; other columns are ignored.
    """
    p = params or Params()
    ordered = F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID))
    body = F.coalesce(F.col(text), F.lit(""))
    all_ = docs.select(key, *keep, ordered.alias("id"), F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
    total = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    firsts = all_.groupBy("sha").agg(F.min("id").alias("id"))
    # One exchange of the texts, by a hash of key and text, serves all three uses below: texts of one key, or without one, don't meet. Should two
    # such hashes ever agree, text and key tell them apart, in a form that doesn't become a second join key, which would deal the texts anew.
    node = F.xxhash64("id", "sha").alias("node")
    firsts = firsts.select(node, F.col("sha").alias("_sha"), F.col("id").alias("_id"))
    texts = docs.select(ordered.alias("id"), body.cast("binary").alias("data"), F.sha2(body, 256).alias("sha"))
    base = texts.select("id", "data", "sha", node).join(firsts, "node").filter((F.instr("sha", F.col("_sha")) == 1) & (F.col("id") >= F.col("_id")) & (F.col("id") <= F.col("_id"))).drop("_sha", "_id")
    coarse, fine = (max(1, math.ceil(total / n)) for n in (p.candidate_bytes, p.shard_bytes))
    shared = shared_minimizers(minimizer_blobs(base, coarse, p), max(1, math.ceil(total / p.part_bytes)))
    found = removals(snippet_blobs(base.join(shared, "node"), fine, p), p)
    found = found.groupBy("node").agg(F.collect_list(F.struct("id", "spans")).alias("found"))
    own = F.transform(F.filter("found", lambda x: x["id"] == F.col("id")), lambda x: x["spans"])
    cut = base.join(found, "node", "left").withColumn("spans", own)

    added = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    added |= {"kept_text": pa.string()} if kept_text else {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in added}
            for data, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = _union(np.frombuffer(b"".join(spans or []), "<i8").reshape(-1, 2))
                out["n_removed"].append(sum(b - a for a, b in gone))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(_without(data, gone)).hexdigest())
                if kept_text:
                    out["kept_text"].append(_without(data, _whole_characters(data, gone)).decode("utf-8", "replace"))
            arrays = [pa.array(out[name], kind) for name, kind in added.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["sha", "_first", *added])

    schema = "sha string, _first long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * kept_text
    done = cut.select("sha", F.col("id").alias("_first"), "data", "spans").mapInArrow(work, schema)
    done = done.dropDuplicates(["sha"]) if not kept_text else done.groupBy("sha").agg(*[F.first(c).alias(c) for c in ("_first", *added)])
    joined = all_.join(done, "sha")
    copy = (F.col("id") > F.col("_first")) & (F.col("n_bytes") >= p.length)
    return joined.select(
        key,
        *keep,
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text")] if kept_text else []),
    )

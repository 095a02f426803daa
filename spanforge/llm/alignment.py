"""Alignment of two tokenizers: token ends meet in Arrow tables, Spark merges the counts of id pairs."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.packing import ChunkEncoder, byte_ranks
from spanforge.llm.shared import text_or_empty
from spanforge.session import fresh_dir

# Characters aligned at a time; one longer text is a portion of its own.
PORTION = 1_000_000
# A part, the unit that asks for counts, ends after so many characters or id pairs.
PART_CHARS = 16_000_000
PART_PAIRS = 1_000_000
# Occurrences of a table of pairs at a time.
PAIRS = 2_000_000
# Pairs of a group beyond which its equal ids are counted first.
SMALL = 256
# Ids of the second tokenizer are below this; a pair is one number of 32 bits, sent as a signed one.
SECOND = 1 << 16
SEGMENT = re.compile(" +[^ ]*")


class PieceEncoder:
    """Ids of a sentencepiece model, run of spaces and word at a time, with a bounded cache.

    Where no piece of the model holds a space after something else, no merge crosses the beginning of a run of spaces, so the
    parts may be encoded apart. Texts of other models are encoded whole.
    """

    def __init__(self, path: str, cache: int = 150_000) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if len(self.pieces) > SECOND:
            raise ValueError(f"at most {SECOND} pieces are supported")
        self.apart = not any(re.search("[^▁]▁", p) for p in self.pieces)
        self.space = np.array([self.model.piece_to_id("▁")], np.int32).tobytes()
        self.cache: dict[str, bytes] = {}
        self.limit = cache

    def _learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of segments; the model adds one space itself, but to an empty text."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        ids = {s: array("i", i).tobytes() if len(s) > 1 else self.space for s, i in zip(segments, found, strict=True)}
        if len(self.cache) + len(ids) > self.limit:
            self.cache.clear()
        self.cache |= {s: i for s, i in ids.items() if len(s) <= 64}
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """32-bit ids of each text."""
        split = [SEGMENT.findall(" " + t) if t and self.apart and "▁" not in t else None for t in texts]
        known = {s: self.cache.get(s) for segments in split if segments for s in segments}
        missing = [s for s, ids in known.items() if ids is None]
        for start in range(0, len(missing), 10_000):
            known |= self._learn(missing[start : start + 10_000])
        for text, segments in zip(texts, split, strict=True):
            if segments is None:
                yield array("i", self.model.encode(text, num_threads=1)).tobytes()
            else:
                yield b"".join(map(known.__getitem__, segments))

    def token_bytes(self) -> list[bytes]:
        """Bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
        return [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)
        ]


class TokenTable:
    """Bytes of ids, to be looked up for many ids at once."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    def join(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        where = np.repeat(self.places[ids] - (np.cumsum(sizes) - sizes), sizes)
        where += np.arange(len(where))
        return self.blob[where]


class Aligner:
    """Both tokenizers of a task and the alignment of a portion of texts."""

    def __init__(self, first: str, second: str) -> None:
        ranks = byte_ranks(first)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.a_encoder, self.b_encoder = ChunkEncoder(first, cache=150_000), PieceEncoder(second)
        self.a_table, self.b_table = TokenTable(tokens), TokenTable(self.b_encoder.token_bytes())

    def _tokens(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of each text by both tokenizers as Arrow lists; texts whose bytes do not come back have none."""
        a_ids, b_ids = [], []
        made = zip(self.a_encoder.encode([" " + t if t else "" for t in texts]), self.b_encoder.encode(texts), strict=True)
        for text, (a, b) in zip(texts, made, strict=True):
            a, b = np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)
            whole = (" " + text).encode() if text else b""
            if self.a_table.join(a).tobytes() != whole or self.b_table.join(b).tobytes() != whole:
                a = b = a[:0]
            a_ids.append(a)
            b_ids.append(b)
        return _lists(a_ids), _lists(b_ids)

    def align(self, texts: list[str]) -> tuple[pa.Table, pa.Table]:
        """(measures of each text, links of each text and id pair): lists are flattened, token ends joined, groups joined."""
        a_lists, b_lists = self._tokens(texts)
        a, b = _flat(a_lists, self.a_table.sizes), _flat(b_lists, self.b_table.sizes)
        # Ends that both have, keyed by document and end.
        shared = a.select(["key", "at"]).join(b.select(["key", "at"]), "key", join_type="inner", right_suffix="_b", use_threads=False)
        a_group, n_groups = _groups(a, shared["at"])
        b_group, _ = _groups(b, shared["at_b"])
        a = a.append_column("group", pa.array(a_group))
        b = b.append_column("group", pa.array(b_group))
        pairs = _pairs(a, b, n_groups)
        doc_of_group = np.zeros(n_groups, np.int64)
        doc_of_group[a_group] = a["doc"].to_numpy()
        per_doc = pairs.group_by("doc", use_threads=False).aggregate([("links", "sum")])
        n_links = np.zeros(len(texts), np.int64)
        n_links[per_doc["doc"].to_numpy()] = per_doc["links_sum"].to_numpy()
        counts = {
            "n_a": a_lists.value_lengths().cast(pa.int64()),
            "n_b": b_lists.value_lengths().cast(pa.int64()),
            "n_groups": pa.array(np.bincount(doc_of_group, minlength=len(texts)).astype(np.int64)),
            "n_links": pa.array(n_links),
            "groups_sha256": pa.array(self._digests(a, b, n_groups, doc_of_group, len(texts))),
        }
        return pa.table(counts), pairs

    @staticmethod
    def _digests(a: pa.Table, b: pa.Table, n_groups: int, doc_of_group: np.ndarray, n_docs: int) -> list[str]:
        sides = []
        for side in (a, b):
            ends = np.cumsum(np.bincount(side["group"].to_numpy(), minlength=n_groups))
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            ids = side["id"].combine_chunks().cast(pa.string())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, ids), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        ends = np.cumsum(np.bincount(doc_of_group, minlength=n_docs))
        texts = pc.binary_join(pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), groups), ";")
        return [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts.to_pylist()]


@lru_cache(maxsize=1)
def shared_aligner(first: str, second: str) -> Aligner:
    """One per Python worker, so that short tasks do not load the files again; its caches are bounded."""
    return Aligner(first, second)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32))


def _flat(lists: pa.ListArray, sizes: np.ndarray) -> pa.Table:
    """One row per token: doc, id, at (place in the portion), key (document and the byte at which the token ends)."""
    doc = pc.list_parent_indices(lists).cast(pa.int64())
    ids = pc.list_flatten(lists)
    ends = pc.cumulative_sum(pc.take(pa.array(sizes), ids))
    # The segmented sum: what the documents before hold is taken off.
    firsts = np.asarray(lists.offsets)[:-1]
    before = np.append(0, ends.to_numpy())[firsts]
    own = pc.subtract(ends, pc.take(pa.array(before), doc))
    key = pc.add(pc.shift_left(doc, pa.scalar(40, pa.int64())), own)
    return pa.table({"doc": doc, "id": ids, "at": pa.array(np.arange(len(ids))), "key": key})


def _groups(tokens: pa.Table, closing: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """(group of each token, number of groups): a group ends with each token whose end both sides have."""
    flags = np.zeros(tokens.num_rows, np.int64)
    flags[closing.to_numpy()] = 1
    return pc.cumulative_sum(pa.array(flags)).to_numpy() - flags, int(flags.sum())


def _pairs(a: pa.Table, b: pa.Table, n_groups: int) -> pa.Table:
    """doc, pair, links: groups join on their numbers, in slices of a bounded number of pairs.

    In a group of more than SMALL pairs equal ids count as one first, so what is joined grows with its kinds of ids.
    """
    sizes = [np.bincount(t["group"].to_numpy(), minlength=n_groups) for t in (a, b)]
    large = sizes[0] * sizes[1] > SMALL
    out = []
    if large.any():
        own, other = (t.filter(pa.array(large[t["group"].to_numpy()])) for t in (a, b))
        own = own.group_by(["group", "id", "doc"], use_threads=False).aggregate([("id", "count")]).sort_by("group")
        other = other.group_by(["group", "id"], use_threads=False).aggregate([("id", "count")]).sort_by("group")
        out += _joined(own, other.rename_columns({"id": "id_b", "id_count": "count_b"}), n_groups)
        a, b = (t.filter(pa.array(~large[t["group"].to_numpy()])) for t in (a, b))
    out += _joined(a.select(["group", "id", "doc"]), b.select(["group", "id"]).rename_columns(["group", "id_b"]), n_groups)
    none = pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    total = out[0] if len(out) == 1 else _sum(pa.concat_tables([none, *out]), ["key"], "links")
    key = total["key"]
    pair = pc.bit_wise_and(key, pa.scalar((1 << 32) - 1, pa.int64()))
    return pa.table({"doc": pc.shift_right(key, pa.scalar(32, pa.int64())), "pair": pair, "links": total["links"]})


def _joined(a: pa.Table, b: pa.Table, n_groups: int) -> list[pa.Table]:
    """Tables of key (document and pair) and links; both sides are in the order of their groups."""
    a_group, b_group = a["group"].to_numpy(), b["group"].to_numpy()
    made = np.cumsum(np.bincount(b_group, minlength=n_groups)[a_group])
    out, start = [], 0
    while start < a.num_rows:
        done = made[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(made, done + PAIRS, side="right")))
        low, high = np.searchsorted(b_group, [a_group[start], a_group[stop - 1] + 1])
        joined = a.slice(start, stop - start).join(b.slice(low, high - low), "group", join_type="inner", use_threads=False)
        first = pc.multiply(joined["id"].cast(pa.int64()), SECOND)
        pair = pc.add(first, joined["id_b"].cast(pa.int64()))
        key = pc.add(pc.shift_left(joined["doc"], pa.scalar(32, pa.int64())), pair)
        if "count_b" in joined.column_names:
            links = pc.multiply(joined["id_count"], joined["count_b"])
            out.append(_sum(pa.table({"key": key, "links": links}), ["key"], "links"))
        else:
            counted = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([("key", "count")])
            out.append(counted.rename_columns(["key", "links"]))
        start = stop
    return out


def _sum(table: pa.Table, by: list[str], value: str) -> pa.Table:
    return table.group_by(by, use_threads=False).aggregate([(value, "sum")]).rename_columns({f"{value}_sum": value})


MEASURES = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string"}


def _align_tasks(docs: DataFrame, first: str, second: str, key: str, text: str) -> DataFrame:
    """Rows of documents (``counts`` null) and, closing each part, one row with the part's pairs and their document counts."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = None
        number, chars, partial, waiting = 0, 0, [], 0
        base = TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            total = _sum(pa.concat_tables(partial), ["pair"], "n").sort_by("pair")
            return _batch(pa.nulls(1, key_type), base + number, None, [total["pair"].combine_chunks()], [total["n"].combine_chunks()], 1)

        key_type = None
        for batch in batches:
            key_type = batch.column(2).type
            lengths = batch.column(1).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop, size = start + 1, lengths[start]
                while stop < batch.num_rows and size + lengths[stop] <= PORTION:
                    size += lengths[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                aligner = aligner or shared_aligner(first, second)
                measures, pairs = aligner.align(part.column(0).to_pylist())
                pairs = pairs.sort_by([("doc", "ascending"), ("pair", "ascending")])
                cuts = np.searchsorted(pairs["doc"].to_numpy(), np.arange(part.num_rows + 1))
                own = pairs["pair"].combine_chunks(), pairs["links"].combine_chunks()
                lists = [[values[a:b] for a, b in zip(cuts, cuts[1:])] for values in own]
                yield _batch(part.column(2), base + number, measures, lists[0], lists[1], part.num_rows)
                partial.append(pairs.group_by("pair", use_threads=False).aggregate([("doc", "count")]).rename_columns({"doc_count": "n"}))
                chars += size
                waiting += partial[-1].num_rows
                if chars > PART_CHARS or waiting > PART_PAIRS:
                    yield close()
                    number, chars, partial, waiting = number + 1, 0, [], 0
                start = stop
        if partial:
            yield close()
        pa.default_memory_pool().release_unused()

    def _batch(keys, part: int, measures, pairs: list, values: list, n: int) -> pa.RecordBatch:
        columns = [keys, pa.array([part] * n, pa.int64()), pa.array([measures is not None] * n)]
        for name, ddl in MEASURES.items():
            empty = pa.nulls(n, pa.int64() if ddl == "long" else pa.string())
            columns.append(empty if measures is None else measures[name].combine_chunks())
        for lists in (pairs, values):
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            flat = np.concatenate([*[x.to_numpy() for x in lists], np.empty(0, np.int64)])
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.uint32).view(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=[key, "_part", "_is_doc", *MEASURES, "_pairs", "_values"])

    value = text_or_empty(text)
    narrow = docs.select(value.alias("_text"), F.char_length(value).alias("_length"), key)
    measured = ", ".join(f"{n} {d}" for n, d in MEASURES.items())
    schema = f"`{key}` {kind.simpleString()}, _part long, _is_doc boolean, {measured}, _pairs array<int>, _values array<int>"
    return narrow.mapInArrow(run, schema)


def align_texts(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    ``first`` is a byte-level BPE file of the tokenizers library, which encodes a space and the text; ``second`` is a sentencepiece
    model, which adds the space itself. Strings of special tokens inside texts are ordinary text. Bytes at which tokens of
    both end cut the tokens into groups; every pair of tokens of a group is a link. ``count`` of an id pair is the number of
    documents that hold it linked; ``n_best`` counts links with the highest count of their first id, ``count_sum`` adds the counts of all
    links. Texts whose bytes do not come back from both tokenizers have no tokens, nor have null and empty ones.

    Tasks encode each text once, and write its measures and distinct pairs to the shared folder. Counts are first summed over
    parts of about 16 million characters; each part then gets the counts of its own pairs back, so neither the driver nor any task
    holds the table of all pairs, and a pair that all documents hold is one row per part. Repeated rows, ties and null
    keys stay documents of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    place = fresh_dir(spark, "aligned")
    _align_tasks(docs, first, second, key, text).write.parquet(place)
    rows = spark.read.parquet(place)
    named = rows.filter(~F.col("_is_doc")).select("_part", F.explode(F.arrays_zip("_pairs", "_values")).alias("p"))
    named = named.select("_part", F.col("p._pairs").alias("pair"), F.col("p._values").alias("n"))
    totals = named.groupBy("pair").agg(F.sum("n").alias("total"))
    # One row for each id of the first tokenizer, whose number its vocabulary bounds.
    best = totals.groupBy(F.shiftrightunsigned("pair", 16).alias("a")).agg(F.max("total").alias("most"))
    ranked = totals.join(F.broadcast(best), F.shiftrightunsigned("pair", 16) == F.col("a"))
    ranked = ranked.select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    asked = named.select("_part", "pair").join(ranked, "pair").select("_part", "pair", "total", "best")
    measured = rows.filter("_is_doc").select(F.col("_part").alias("_own"), key, *MEASURES, "_pairs", "_values")

    def finish(ids: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        pairs = left["_pairs"].combine_chunks()
        links = pa.table(
            {
                "doc": pc.list_parent_indices(pairs).cast(pa.int64()),
                "pair": pc.list_flatten(pairs),
                "links": pc.list_flatten(left["_values"].combine_chunks()),
            }
        )
        if right.num_rows:
            found = links.join(right.select(["pair", "total", "best"]), "pair", join_type="inner", use_threads=False)
            if found.num_rows != links.num_rows:
                raise ValueError("counts of pairs are missing")
            added = pc.multiply(found["links"], found["total"])
            top = pc.if_else(found["best"], found["links"], 0)
            per_doc = pa.table({"doc": found["doc"], "count_sum": added, "n_best": top})
            per_doc = per_doc.group_by("doc", use_threads=False).aggregate([("count_sum", "sum"), ("n_best", "sum")])
        out = {name: np.zeros(n, np.int64) for name in ("n_best", "count_sum")}
        if right.num_rows:
            for name in out:
                out[name][per_doc["doc"].to_numpy()] = per_doc[f"{name}_sum"].to_numpy()
        table = left.select([key, *MEASURES])
        for name, values in out.items():
            table = table.append_column(name, pa.array(values))
        return table

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} {d}" for n, d in MEASURES.items()) + ", n_best long, count_sum long"
    return measured.groupBy("_own").cogroup(asked.groupBy("_part")).applyInArrow(finish, schema)

"""Best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import map_texts
from spanforge.session import checkpoint

CAPACITY = 1024
# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Pieces packed together in one task. Pieces are dealt by hash, so tasks are alike at any input size.
PER_TASK = 8_000


def byte_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id of a byte-level BPE file of the tokenizers library, whose ids rise with its merges."""
    model = json.loads(Path(path).read_text())["model"]
    # The byte alphabet: printable bytes stand for themselves, the others follow from code point 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(ids):
        raise ValueError("ids do not rise with the merges")
    single = {s: model["vocab"][s] for s in signs}
    tokens = {t: i for t, i in model["vocab"].items() if i >= ids[0] and i <= ids[-1]} | single
    return {bytes(signs[c] for c in t): i for t, i in tokens.items()}


class ChunkEncoder:
    """Ids of ordinary text (no added tokens) as the tokenizers library gives them, chunk by chunk, with a bounded cache.

    The split pattern of byte-level BPE begins a new token at every space after a non-space and at every space
    before one, so a text may be cut there and its chunks encoded apart. Texts with longer runs of white space
    around a space are encoded whole. New chunks are encoded by the tiktoken library from the same merges, several times
    faster here; the tests hold the ids against the tokenizers library.
    """

    wide = re.compile(r"\s (?:\s|$)")

    def __init__(self, path: str, cache: int = 500_000) -> None:
        import tiktoken

        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.limit = cache

    def _ids(self, text: str) -> bytes:
        return array("I", self.own.encode_ordinary(text)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids = self._ids(" " + chunk)
        if len(chunk) <= 64 and len(self.cache) < self.limit:
            self.cache[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        get, missing = self.cache.get, self._chunk
        for text in texts:
            if not text or self.wide.search(text):
                yield self._ids(text)
                continue
            first, *rest = text.split(" ")
            yield b"".join([self._ids(first), *[get(w) or missing(w) for w in rest]])


class TextEncoder:
    """Ids as the tokenizers library gives them with the file as it is loaded: its added tokens keep their own ids.

    The library cuts a text at its added tokens, leftmost and longest first, and encodes the parts apart. Texts of a file whose
    added tokens also look at their neighbours (single words, stripped white space) go to the library itself where they hold one.
    """

    def __init__(self, path: str) -> None:
        added = [t for t in json.loads(Path(path).read_text()).get("added_tokens") or [] if t["content"]]
        self.plain = ChunkEncoder(path)
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.library = None
        if any(t.get(name) for t in added for name in ("single_word", "lstrip", "rstrip")):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if not any(t in text for t in self.added):
                yield from self.plain.encode([text])
            elif self.library is not None:
                yield array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                parts = self.marks.split(text)  # every second part is an added token
                parts[::2] = self.plain.encode(parts[::2])
                parts[1::2] = [self.added[t] for t in parts[1::2]]
                yield b"".join(parts)


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """key, piece, start, length, ids_crc32: documents with their end id, cut into pieces of ``capacity``."""

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"lengths": [], "crcs": []}
        end = int(end_id).to_bytes(4, "little")
        for ids in text_encoder(tokenizer).encode(texts):
            ids += end
            n = len(ids) // 4
            first = n % capacity or capacity
            cuts = [0, *range(first, n + 1, capacity)]
            out["lengths"].append([b - a for a, b in zip(cuts, cuts[1:])])
            out["crcs"].append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])])
        return out

    added = {"lengths": pa.list_(pa.int64()), "crcs": pa.list_(pa.int64())}
    cut = map_texts(docs, [key], text, work, added)
    cut = cut.select(key, F.col("lengths")[0].alias("_first"), F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "_p"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("_first") + (F.col("piece") - 1) * capacity)
    return cut.select(
        key, "piece", start.cast("long").alias("start"), F.col("_p.lengths").alias("length"), F.col("_p.crcs").alias("ids_crc32")
    )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. ``sizes`` falls."""
    gaps: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for item, size in enumerate(sizes):
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        if gap > size:
            insort(gaps, (gap - size, b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves, one-for-one and two-for-one exchanges.

    Every step takes tokens out of the emptiest bin that is still being worked on and into a fuller one, so the sum of squared
    fills only grows; each step adds at least one token to another bin, which bounds their number.
    """
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    open_bins = [int(b) for b in np.argsort(fill, kind="stable") if fill[b] < capacity]
    if len(open_bins) < 2 or int((capacity - fill[open_bins]).sum()) < int(fill[open_bins[0]]):
        return bins  # the gaps together can't take the emptiest bin
    items = np.array([i for b in open_bins for i in bins[b]], np.int64)
    size = np.array([sizes[i] for i in items], np.int64)
    home = np.array([b for b in open_bins for _ in bins[b]], np.int64)
    alive = np.zeros(len(fill), bool)
    alive[open_bins] = True
    for donor in open_bins:
        if int((capacity - fill[alive]).sum()) - (capacity - int(fill[donor])) < int(fill[donor]):
            break
        while True:
            own = np.flatnonzero(home == donor)
            if not len(own):
                break
            step = _step(own, donor, size, home, fill, alive, capacity)
            if step is None:
                break
            out, back = step
            target = int(home[back]) if back >= 0 else step_target(out, donor, size, home, fill, alive, capacity)
            moved = int(size[out].sum()) - (int(size[back]) if back >= 0 else 0)
            home[out] = target
            if back >= 0:
                home[back] = donor
            fill[target] += moved
            fill[donor] -= moved
        alive[donor] = False  # emptied, or stuck: it gives and takes nothing more
    new: dict[int, list[int]] = {}
    for i, b in zip(items.tolist(), home.tolist(), strict=True):
        new.setdefault(b, []).append(i)
    closed = [b for k, b in enumerate(bins) if fill[k] == capacity and k not in new and k not in set(open_bins)]
    return closed + list(new.values())


def step_target(out, donor, size, home, fill, alive, capacity) -> int:
    """The fullest other bin that takes the items ``out``."""
    gap = np.where(alive, capacity - fill, -1)
    gap[donor] = -1
    fits = np.flatnonzero(gap >= int(size[out].sum()))
    return int(fits[np.argmin(gap[fits])])


def _step(own, donor, size, home, fill, alive, capacity):
    """(items to give, item taken back or -1) of the best step for a donor, or None."""
    gap = capacity - fill
    other = alive & (np.arange(len(fill)) != donor)
    most = int(gap[other].max(initial=0))
    for k in own:
        if size[k] <= most:
            return np.array([k]), -1  # a move
    room = np.where(other[home], gap[home], -1)
    usable = np.flatnonzero(room >= 0)
    if not len(usable):
        return None
    # What could stand in place of each item, falling: of the items that reach a sum, the smallest is the one to take back.
    reach = (size + room)[usable]
    order = np.argsort(-reach, kind="stable")
    reach, items = reach[order], usable[order]
    fresh = np.append(True, size[items][1:] < np.minimum.accumulate(size[items])[:-1])
    least = items[np.maximum.accumulate(np.where(fresh, np.arange(len(items)), 0))]
    # All single items and all pairs of the donor; equal sizes are one, so there are few sums.
    kinds, count = np.unique(size[own], return_counts=True)
    a, b = np.triu_indices(len(kinds))
    a, b = a[(a < b) | (count[a] > 1)], b[(a < b) | (count[a] > 1)]
    give = np.concatenate([kinds, kinds[a] + kinds[b]])
    covered = np.searchsorted(-reach, -give, side="right")
    back = least[np.maximum(covered - 1, 0)]
    two = np.arange(len(give)) >= len(kinds)  # two-for-one also leaves one item less
    gain = np.where((covered > 0) & (size[back] < give), give - size[back] + two, 0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return None
    if not two[best]:
        return own[size[own] == kinds[best]][:1], int(back[best])
    x, y = kinds[a[best - len(kinds)]], kinds[b[best - len(kinds)]]
    return np.array([own[size[own] == x][0], own[size[own] == y][-1]]), int(back[best])


def pack_sizes(sizes: np.ndarray, capacity: int, before: np.ndarray | None = None) -> np.ndarray:
    """Bin number of each item; the grouping ``before`` is kept where it needs no more bins."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    bins = local_search(best_fit(falling, capacity), falling, capacity)
    if before is not None and len(np.unique(before)) <= len(bins):
        return np.unique(before, return_inverse=True)[1]
    out = np.empty(len(sizes), np.int64)
    for number, members in enumerate(bins):
        out[order[members]] = number
    return out


def _pack(pieces: DataFrame, parts: int, round_number: int, capacity: int, key: str) -> DataFrame:
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("_row", "ascending")])
        sizes = table["length"].to_numpy()
        old = None if round_number == 0 else table["sequence_id"].to_numpy()
        number = pack_sizes(sizes, capacity, old)
        order = np.argsort(number, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], np.diff(number[order]) > 0])
        base = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - base
        fill = np.bincount(number, sizes)[number].astype(np.int64)
        bucket = table["_bucket"][0].as_py()
        ids = (round_number << 58) + (bucket << 30) + number
        out = table.drop_columns([c for c in ("sequence_id", "offset", "_fill", "_bucket") if c in table.column_names])
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("_fill", pa.array(fill))

    spread = F.col("_row") if round_number == 0 else F.col("sequence_id")
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(spread, F.lit(round_number)), F.lit(parts)))
    kind = pieces.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, _row long, sequence_id long, offset long, _fill long"
    return dealt.groupBy("_bucket").applyInArrow(work, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    per_task: int = PER_TASK,
    rounds: int = 3,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is encoded whole, closed by ``end_id``, and cut only if longer than ``capacity``; its first piece may
    then be shorter. Pieces are dealt to tasks by hash, packed best-fit decreasing and improved by
    :func:`local_search`. In the later rounds the sequences that stayed underfull meet those of other tasks and
    are packed anew; a round never needs more sequences than the one before. Only sizes and keys are shuffled.

    Null and empty texts are one piece with the end id alone. Repeated rows, ties and null keys are documents
    of their own. An empty table gives no rows; other columns are ignored.
    """
    pieces = checkpoint(cut_pieces(docs, tokenizer, end_id, capacity, key, text))
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    done, rows = [], pieces.count()
    for r in range(rounds):
        parts = max(1, math.ceil(rows / per_task))
        packed = _pack(pieces, parts, r, capacity, key)
        if r == rounds - 1 or parts == 1:
            done.append(packed)
            break
        packed = checkpoint(packed)
        done.append(packed.filter(F.col("_fill") == capacity))
        pieces = packed.filter(F.col("_fill") < capacity)
        rows = pieces.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

"""Byte-level BPE: boundaries by an associative scan over transition functions, then cached pair merging."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.shared import map_texts

# White space of the split pattern, and the endings that follow an apostrophe.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")

# Classes of code points, then of positions: the last three of the latter depend on what follows.
LETTER, NUMBER, OTHER, BLANK = range(4)
RESET, ENDING1, ENDING2, INNER, JOINING, LAST = range(4, 10)
N_CLASSES = 10
# States: at the border after a token that cannot grow, or inside a run of a kind.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
N_STATES = 8


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    table = np.full(0x110001, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE)] = BLANK
    table[0x110000] = RESET
    return table


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a token begins here)."""
    grows = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    if kind == RESET:
        return FRESH, True
    if state == TWO_MORE and kind == LETTER:
        return ONE_MORE, False
    if state == ONE_MORE and kind == LETTER:
        return FRESH, False
    if kind in (ENDING1, ENDING2):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (ONE_MORE if kind == ENDING1 else TWO_MORE), True
    if kind in grows:
        return grows[kind], state not in (grows[kind], AFTER_SPACE)
    if kind == INNER:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if kind == JOINING else FRESH), True


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition table, functions as state maps, whether a token begins).

    The functions from states to states that the classes make are closed under composition, so a scan
    over positions is a scan over their numbers with a table look-up as its operation.
    """
    single = [tuple(_step(s, k)[0] for s in range(N_STATES)) for k in range(N_CLASSES)]
    known = {tuple(range(N_STATES)): 0}
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in single:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    maps = sorted(known, key=known.get)
    table = np.array([[known[tuple(g[s] for s in f)] for g in maps] for f in maps], np.int16)
    begins = np.array([[_step(s, k)[1] for k in range(N_CLASSES)] for s in range(N_STATES)])
    return np.array([known[f] for f in single], np.int16), table, np.array(maps, np.uint8), begins


def position_classes(codes: np.ndarray) -> np.ndarray:
    """Classes of positions; ``codes`` ends with the reset code."""
    kinds = code_point_classes()[codes].copy()
    blank = np.flatnonzero(kinds == BLANK)
    after = kinds[blank + 1]
    joins = np.where(codes[blank] == 32, JOINING, LAST)
    kinds[blank] = np.where((after == BLANK) | (after == RESET), INNER, joins)
    marks = np.flatnonzero(codes == ord("'"))
    one = codes[np.minimum(marks + 1, len(codes) - 1)]
    two = codes[np.minimum(marks + 2, len(codes) - 1)]
    for e in ENDINGS:
        hit = one == ord(e[0])
        if len(e) == 2:
            hit &= two == ord(e[1])
        kinds[marks[hit]] = ENDING1 if len(e) == 1 else ENDING2
    return kinds


def scan_states(kinds: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each position: rows of ``width`` are scanned side by side, then their totals."""
    single, table, maps, _ = machine()
    n = len(kinds)
    rows = -(-n // width)
    grid = np.full(rows * width, RESET, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = table.ravel(), table.shape[0]
    before = np.empty((width, rows), np.int16)
    acc = np.zeros(rows, np.int32)
    for j in range(width):
        before[j] = acc
        acc = flat[acc * size + single[grid[j]]].astype(np.int32)
    totals, gap = acc.copy(), 1
    while gap < rows:
        totals[gap:] = flat[totals[:-gap] * size + totals[gap:]]
        gap *= 2
    start = np.zeros(rows, np.int64)
    start[1:] = maps[totals[:-1], FRESH]
    return maps[before, start].T.ravel()[:n]


def boundaries(texts: list[str]) -> Iterator[list[int]]:
    """For each text the places where tokens begin, and its end; all texts in one scan."""
    if not texts:
        return
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    codes = np.insert(codes, ends, 0x110000)
    kinds = position_classes(codes)
    begins = machine()[3].ravel()[scan_states(kinds).astype(np.int32) * N_CLASSES + kinds]
    places = np.flatnonzero(begins)
    stops = ends + np.arange(len(texts))
    starts = stops - lengths
    cut = np.searchsorted(places, stops, side="right")
    at = 0
    for a, c in zip(starts.tolist(), cut.tolist(), strict=True):
        yield (places[at:c] - a).tolist()
        at = c


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens with their ranks."""
    pairs = map(bytes.split, Path(path).read_bytes().splitlines())
    return {base64.b64decode(a): int(b) for a, b in pairs}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank is merged, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 40
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long slices: a heap of pairs over a linked list, n log n."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, size = heapq.heappop(heap)
        a, b = parts[i], parts[j]
        if a is None or b is None or right[i] != j or len(a) + len(b) != size:
            continue
        parts[i], parts[j] = a + b, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0:
                both = parts[x] + parts[y]
                if (r := ranks.get(both)) is not None:
                    heapq.heappush(heap, (r, x, y, len(both)))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts by a rank file; slices seen before come from a bounded cache."""

    def __init__(self, path: str, cache: int = 1_000_000) -> None:
        self.ranks = read_ranks(path)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.cache: dict[str, bytes] = {}
        self.limit = cache

    def _slice(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= 64 and len(self.cache) < self.limit:
            self.cache[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get, missing = self.cache.get, self._slice
        for text, cuts in zip(texts, boundaries(texts), strict=True):
            pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
            yield b"".join([get(p) or missing(p) for p in pieces])

    def decode(self, ids: bytes) -> tuple[bytes, np.ndarray]:
        """(the decoded bytes, the place in them at which each id's bytes begin)."""
        found = np.frombuffer(ids, "<u4")
        sizes = self.sizes[found]
        offsets = np.cumsum(sizes) - sizes
        where = np.repeat(self.places[found] - offsets, sizes)
        where += np.arange(len(where))
        return self.blob[where].tobytes(), offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; it outlives tasks, so its cache does too."""
    return Encoder(path)


def encode_texts(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256[, ids, offsets].

    ``ids`` are little-endian unsigned 32-bit numbers, ``offsets`` the byte place of each in the decoded text.
    Null and empty texts have no tokens. Texts of any length are encoded whole. Repeated rows, ties and
    null keys stay rows of their own; an empty table gives no rows; other columns are ignored.
    """
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    added |= {"ids": pa.binary(), "offsets": pa.list_(pa.int64())} if ids else {}

    def work(texts: list[str]) -> dict[str, Iterable]:
        own = encoder(ranks)
        out: dict[str, list] = {name: [] for name in added}
        for found in own.encode(texts):
            out["n_tokens"].append(len(found) // 4)
            out["ids_sha256"].append(hashlib.sha256(found).hexdigest())
            decoded, offsets = own.decode(found)
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if ids:
                out["ids"].append(found)
                out["offsets"].append(offsets)
        return out

    return map_texts(docs, [key], text, work, added)

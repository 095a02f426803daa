"""BPE of whole words by chunks: rolling-hash cuts, chunks encoded once, their joins encoded again until both sides agree."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.shared import map_texts

# A cut depends on the WINDOW code points before it; chunks have MEAN code points on average and at most LONGEST.
WINDOW = 16
MEAN_BITS = 9
LONGEST = 4_096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Where one of these stands, no token, no composed character and no rule of the tokenizer reaches across.
SEAMS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# str.split() also splits at these.
OTHER_BLANKS = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Letters and signs whose classes and lower case no version of Unicode has changed, and that compose with nothing among them.
SETTLED = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
# Normalizers that look no further than a character and the marks that follow it.
LOCAL_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}


def rolling_cuts(codes: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Places at which the hash of the last WINDOW code points asks for a cut; equal surroundings give equal cuts."""
    found = []
    for start in range(0, len(codes), block):
        low = max(0, start - WINDOW + 1)
        h = codes[low : start + block].astype(np.uint64) + np.uint64(1)
        power, width = MULTIPLIER, 1
        while width < WINDOW and len(h) > width:
            with np.errstate(over="ignore"):
                h = h[:-width] * power + h[width:]
                power = power * power
            width *= 2
        if width < WINDOW:
            continue
        with np.errstate(over="ignore"):
            hit = np.flatnonzero((h * MULTIPLIER) >> np.uint64(64 - MEAN_BITS) == 0)
        found.append(hit + low + WINDOW)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut_chunks(texts: list[str]) -> Iterator[list[str]]:
    """The chunks of each text; together they are the text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = rolling_cuts(codes)
    ends = np.cumsum([len(t) for t in texts])
    stops = np.searchsorted(cuts, ends, side="left").tolist()
    at = base = 0
    for text, stop, end in zip(texts, stops, ends.tolist(), strict=True):
        # A window that began in the text before says nothing about this one.
        own = [c - base for c in cuts[at:stop].tolist() if c - base >= WINDOW]
        at, base = int(np.searchsorted(cuts, end, side="right")), end
        chunks, start = [], 0
        for c in [*own, len(text)]:
            while c - start > LONGEST:
                chunks.append(text[start : start + LONGEST])
                start += LONGEST
            if c > start:
                chunks.append(text[start:c])
                start = c
        yield chunks


class Recent:
    """A bounded store: when the newer half is full, the older half goes."""

    def __init__(self, limit: int) -> None:
        self.limit, self.size = limit // 2, 0
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += len(key) + 200


class Chunk:
    """Ids of a chunk, with the words at its ends that a join may change.

    ``head`` and ``tail`` are the texts of its first two and last two words with what lies outside of them; the outer of
    the two may be half a word, the inner one is whole and shows whether a join agrees. Both are None if the chunk has
    less than four words.
    """

    __slots__ = ("ids", "head", "tail", "outer", "inner")

    def __init__(self, text: str, ends: list[str], ids: list[bytes], words: list[bytes]) -> None:
        self.ids = b"".join(ids)
        self.head = self.tail = None
        if len(ends) == 4:
            second = text.index(ends[1], text.index(ends[0]) + len(ends[0]))
            last = text.rindex(ends[3])
            self.head = text[: second + len(ends[1])]
            self.tail = text[text.rindex(ends[2], 0, last) :]
            self.outer = (len(words[0]), len(words[3]))
            self.inner = (words[1], words[2])


def _end_words(text: str) -> list[str] | None:
    """The first two and the last two words of a text with at least four."""
    first = text.split(None, 4)
    return [*first[:2], *text.rsplit(None, 2)[-2:]] if len(first) >= 4 else None


class ChunkedEncoder:
    """Ids exactly as the tokenizers library gives them, with work shared between texts.

    Texts are cut where a rolling hash says so. A chunk seen before comes from a bounded store; a new one is encoded word
    by word, and words seen before come from a store of their own. Chunks may be cut within words, so the
    text around each join is encoded again by the library, from the last whole word before it to the first whole
    word after it. If these two words do not come out as they were, the text around the join is doubled until they
    do, and in the end the whole text is encoded at once.
    """

    def __init__(self, path: str, chunk_chars: int = 16_000_000, most_words: int = 400_000) -> None:
        self.library = load_library(path)
        self.by_words = splits_at_blanks(path)
        self.matches, self.added = settled_matches(path)
        if self.matches:
            names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
            self.closes = np.array([n.endswith(self.library.model.end_of_word_suffix) for n in names])
        self.chunks = Recent(chunk_chars)
        self.joins = Recent(chunk_chars // 2)
        self.matched: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most_words
        self.encoded = self.reused = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _split(self, text: str) -> list[str]:
        return SEAMS.findall(text) if OTHER_BLANKS.search(text) else text.split()

    def _new_chunks(self, texts: list[str]) -> dict[str, Chunk]:
        """Chunks made of their pieces: the file's own matches where the text is settled, else words between blanks."""
        split, whole, loose = [], set(), set()
        for t in texts:
            ends = _end_words(t) if self.matches and SETTLED.fullmatch(t) and not any(a in t for a in self.added) else None
            pieces = self.matches(t.lower()) if ends else self._split(t)
            split.append((t, pieces, ends))
            known = self.matched if ends else self.words
            (whole if ends else loose).update([p for p, ids in zip(pieces, map(known.get, pieces)) if ids is None])
        self._learn(self.matched, list(whole), self._match_ids)
        self._learn(self.words, list(loose), self._library)
        made = {}
        for t, pieces, ends in split:
            get = (self.matched if ends else self.words).__getitem__
            found = list(map(get, pieces))
            if ends:
                words = [b"".join(map(get, self.matches(w.lower()))) for w in ends]
            else:
                ends, words = (pieces[:2] + pieces[-2:] if len(pieces) >= 4 else []), found[:2] + found[-2:]
            made[t] = Chunk(t, ends, found, words)
        for known in (self.matched, self.words):
            if len(known) > self.most:
                known.clear()
        return made

    def _learn(self, known: dict[str, bytes], pieces: list[str], encode) -> None:
        for start in range(0, len(pieces), 10_000):
            part = pieces[start : start + 10_000]
            known.update(zip(part, encode(part), strict=True))

    def _match_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of single matches, many in one text: only the last token of a match bears the file's mark of a word's end."""
        ids = np.array(self.library.encode(" ".join(pieces), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pieces):
            return self._library(pieces)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _join_ids(self, windows: list[str]) -> dict[str, bytes]:
        known = {w: self.joins.get(w) for w in windows}
        missing = [w for w, ids in known.items() if ids is None]
        for w, ids in zip(missing, self._library(missing), strict=True):
            known[w] = ids
            if len(w) <= 256:
                self.joins.put(w, ids)
        return known

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            yield from self._library(texts)
            return
        cut = list(cut_chunks(texts))
        known: dict[str, Chunk] = {}
        fresh: list[str] = []
        for chunks in cut:
            for c in chunks:
                if c not in known:
                    known[c] = self.chunks.get(c)
                    if known[c] is None:
                        fresh.append(c)
        self.encoded += len(fresh)
        self.reused += sum(map(len, cut)) - len(fresh)
        made = self._new_chunks(fresh)
        known |= made
        for text, chunk in made.items():
            self.chunks.put(text, chunk)
        plans = [self._plan(chunks, known) for chunks in cut]
        joins = self._join_ids(list({p[0]: None for plan in plans for p in plan if isinstance(p, tuple)}))
        for text, plan in zip(texts, plans, strict=True):
            out = []
            for part in plan:
                if isinstance(part, bytes):
                    out.append(part)
                    continue
                ids = self._agreed(part, joins[part[0]])
                if ids is None:
                    out = self._library([text])
                    break
                out.append(ids)
            yield b"".join(out)

    def _plan(self, chunks: list[str], known: dict[str, Chunk]) -> list:
        """Ids that stay, and joins as (text, ids it must begin with, ids it must end with, chunk before, chunk after)."""
        plan: list = []
        window, before, left = "", b"", None
        for i, text in enumerate(chunks):
            chunk = known[text]
            first, last = i == 0, i == len(chunks) - 1
            if first and last:
                return [chunk.ids]
            if chunk.head is None:
                window += text
                continue
            start, stop = 0, len(chunk.ids)
            if not first:
                plan.append((window + chunk.head, before, chunk.inner[0], left, text))
                start = chunk.outer[0] + len(chunk.inner[0])
                window = ""
            if not last:
                window, before, left = chunk.tail, chunk.inner[1], text
                stop -= chunk.outer[1] + len(before)
            plan.append(chunk.ids[start:stop])
        if window:
            plan.append((window, before, b"", left, None))
        return plan

    def _agreed(self, join: tuple, ids: bytes) -> bytes | None:
        """The ids of a join, once the whole words at its ends come out as they were; None: encode the text at once."""
        window, before, after, left, right = join
        size, wide = len(ids), window
        # The words of the wider text beyond the join, whose ids stand in the chunks already.
        outside_left = outside_right = b""
        margin = 1
        while not (ids.startswith(outside_left + before) and ids.endswith(after + outside_right) and size >= len(before) + len(after)):
            margin *= 2
            more = []
            for text, own, tail in ((left, before, True), (right, after, False)):
                words = self._split(text) if text is not None else []
                if own and margin + 2 > len(words) - 2:
                    return None
                more.append((words[-2 - margin : -2] if tail else words[2 : 2 + margin]) if own else [])
            wide = " ".join([*more[0], window, *more[1]])
            outside_left, outside_right = (b"".join(self._library(m)) for m in more)
            ids = self._library([wide])[0]
            size = len(ids) - len(outside_left) - len(outside_right)
        return ids[len(outside_left) : len(ids) - len(outside_right)]


@lru_cache(maxsize=1)
def load_library(path: str):
    """The tokenizer of a file, without its truncation and padding; batches stay in the task's own thread."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(maxsize=1)
def splits_at_blanks(path: str) -> bool:
    """Whether words between blanks may be encoded apart: the file drops white space and looks at nothing beyond it.

    Texts of other files are encoded whole.
    """
    file = json.loads(Path(path).read_text())
    steps = _flat(file.get("normalizer"), "normalizers")
    cuts = _flat(file.get("pre_tokenizer"), "pretokenizers")
    return (
        all(s["type"] in LOCAL_NORMALIZERS for s in steps)
        and bool(cuts)
        and cuts[0]["type"] in ("Whitespace", "WhitespaceSplit", "Split")
        and (cuts[0]["type"] != "Split" or (cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not re.search(r"\(\?|\\s\+", cuts[0]["pattern"]["Regex"])))
        and not any(c.get("add_prefix_space") for c in cuts)
        and not any(t.get(name) for t in file.get("added_tokens") or [] for name in ("single_word", "lstrip", "rstrip", "normalized"))
        and file["model"]["type"] == "BPE"
        and not file["model"].get("dropout")
    )


@lru_cache(maxsize=1)
def settled_matches(path: str):
    """(the matches of the file's pattern in a settled text in lower case, its added tokens); None for files of other steps."""
    file = json.loads(Path(path).read_text())
    steps = [s["type"] for s in _flat(file.get("normalizer"), "normalizers")]
    cuts = _flat(file.get("pre_tokenizer"), "pretokenizers")
    added = tuple(t["content"] for t in file.get("added_tokens") or [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["use_regex"] or not file["model"].get("end_of_word_suffix"):
        return None, added
    pattern = cuts[0]["pattern"]["Regex"]
    if "\\p" in re.sub(r"\[[^]]*\]", "", pattern):
        return None, added
    for kind in "LN":
        members = [c for c in map(chr, range(0x180)) if SETTLED.fullmatch(c) and unicodedata.category(c)[0] == kind]
        pattern = pattern.replace(f"\\p{{{kind}}}", "".join(members))
    return re.compile(pattern).findall, added


def _flat(step: dict | None, inner: str) -> list[dict]:
    if step is None:
        return []
    return [s for part in step[inner] for s in _flat(part, inner)] if step["type"] == "Sequence" else [step]


class Decoder:
    """Texts of ids as the library decodes them, special tokens kept.

    A file without a decoder joins its tokens by spaces, which is a look-up; other files are left to the library.
    """

    def __init__(self, path: str) -> None:
        self.library = load_library(path)
        self.plain = self.library.decoder is None
        if self.plain:
            tokens = [self.library.id_to_token(i) or "" for i in range(max(self.library.get_vocab().values()) + 1)]
            self.tokens = np.array([(t + " ").encode() for t in tokens], object)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text."""
        found = np.frombuffer(ids, "<u4")
        if not self.plain:
            return self.library.decode(found.tolist(), skip_special_tokens=False).encode()
        return b"".join(self.tokens[found].tolist())[:-1]


def encode_texts(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", ids: bool = True
) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256[, ids, decoded].

    ``ids`` are little-endian unsigned 32-bit numbers, ``decoded`` is the library's text for them with special tokens kept.
    Strings of the file's added tokens inside texts keep their own ids, as the library does by default.
    Every chunk of a task is encoded once while its bounded store holds it; the stores end with the task. No row is
    shuffled, and a text of any length is encoded whole. Null and empty texts, and texts of white space, have no tokens.
    Repeated rows, ties and null keys stay rows of their own; an empty table gives no rows; other columns are ignored.
    """
    added = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    added |= {"ids": pa.binary(), "decoded": pa.string()} if ids else {}
    own: dict = {}  # filled inside each task

    def work(texts: list[str]) -> dict[str, list]:
        if not own:
            own["encoder"], own["decoder"] = ChunkedEncoder(tokenizer), Decoder(tokenizer)
        out: dict[str, list] = {name: [] for name in added}
        for found in own["encoder"].encode(texts):
            decoded = own["decoder"].decode(found)
            out["n_tokens"].append(len(found) // 4)
            out["ids_sha256"].append(hashlib.sha256(found).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if ids:
                out["ids"].append(found)
                out["decoded"].append(decoded.decode())
        return out

    return map_texts(docs, [key], text, work, added)

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from spanforge.llm import chunk_bpe
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = list("ab'sstmdrevlEé1²  \n\t!.-xñ\r٣中\x1c　\U0001f600İΣς̸́<|>\xa0​한가")
SIGNS += ["<|endoftext|>", "<|startoftext|>", " the", " word ", "é "]


@pytest.fixture(scope="module")
def library():
    return chunk_bpe.load_library(PATH)


def _ids(found):
    return [np.frombuffer(f, "<u4").tolist() for f in found]


def test_ids_and_decoding(library, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MEAN_BITS", 4)  # many joins
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(0, 300))) for _ in range(1_500)]
    texts += ["", " ", "a" * 9_000, "中" * 5_000, "the cat " * 2_000, "It's <|endoftext|>'s"]
    encoder, decoder = chunk_bpe.ChunkedEncoder(PATH, 100_000, 2_000), chunk_bpe.Decoder(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        found = list(encoder.encode(texts))
        assert _ids(found) == want
    for ids, f in zip(want, found, strict=True):
        assert decoder.decode(f).decode() == library.decode(ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]
    passage = " ".join(rnd.choice(words) for _ in range(3_000))
    encoder = chunk_bpe.ChunkedEncoder(PATH)
    list(encoder.encode([passage]))
    before = encoder.encoded
    list(encoder.encode(["another beginning of it " + passage + " and another end"]))
    assert encoder.encoded - before <= 4 and encoder.reused >= before - 3


def test_cuts_depend_on_surroundings_only(monkeypatch):
    rnd = random.Random(3)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    ends = []
    for front in ("", "xyz", "another text before"):
        (chunks,) = chunk_bpe.cut_chunks([front + body])
        assert "".join(chunks) == front + body and max(map(len, chunks)) <= chunk_bpe.LONGEST
        ends.append(set((np.cumsum([len(c) for c in chunks]) - len(front)).tolist()))
    assert len(ends[0]) > 20 and len(ends[0] ^ ends[1]) <= 2 and len(ends[0] ^ ends[2]) <= 2
    codes = np.frombuffer(body.encode("utf-32-le"), np.uint32)
    assert chunk_bpe.rolling_cuts(codes).tolist() == chunk_bpe.rolling_cuts(codes, block=777).tolist()
    monkeypatch.setattr(chunk_bpe, "LONGEST", 50)
    assert list(map("".join, chunk_bpe.cut_chunks(["", body, "", "a" * 400]))) == ["", body, "", "a" * 400]


class Wary:
    """A library that gives other ids to the first word of short texts, so joins disagree until they are wide."""

    def __init__(self, library, least):
        self.library, self.least, self.calls = library, least, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.calls += 1
        short = [len(t.split()) < self.least and len(t.split()) > 1 for t in texts]
        return self.library.encode_batch(["!" + t if s else t for t, s in zip(texts, short)], add_special_tokens=False)

    def __getattr__(self, name):
        return getattr(self.library, name)


def test_joins_that_disagree_are_widened(library):
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(4_000))
    want = library.encode(text, add_special_tokens=False).ids
    for least in (8, 16, 4_000):
        encoder = chunk_bpe.ChunkedEncoder(PATH)
        list(encoder.encode([text]))  # chunks are known, joins are not
        encoder.joins, encoder.library = chunk_bpe.Recent(1_000_000), Wary(library, least)
        (found,) = encoder.encode([text])
        assert _ids([found]) == [want]
        assert encoder.library.calls > 1


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in QUERIES["op12_chunk_bpe"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(odd, none):
    rows = chunk_bpe.encode_texts(odd, PATH).collect()
    assert len(rows) == 11 and sum(r["n_tokens"] == 0 for r in rows) == 4
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and (r["decoded"] == "") == (r["n_tokens"] == 0) for r in rows)
    assert chunk_bpe.encode_texts(none, PATH).count() == 0


def test_files_of_other_steps_are_encoded_whole(library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not chunk_bpe.splits_at_blanks(path)
    texts = ["The cat's  hat\n <|endoftext|> x", ""]
    own = chunk_bpe.ChunkedEncoder(path)
    want = [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    assert _ids(own.encode(texts)) == want

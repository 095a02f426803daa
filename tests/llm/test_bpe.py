import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from spanforge.llm import bpe
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_and_round_trip(library):
    rnd, alphabet = random.Random(5), list("ab'sstmdrevlEé1²  \n\t!.-xñ\r٣中\x1c\u3000\U0001f600")
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 16))) for _ in range(6_000)]
    texts += ["", "a" * 5_000, " " * 700, "'" * 300, "ab" * 3_000, "<|endoftext|>", "we'll've 'tis'd"]
    own = bpe.Encoder(PATH, cache=50)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        decoded, offsets = own.decode(ids)
        assert decoded == text.encode() and len(offsets) == len(ids) // 4


def test_scan_does_not_depend_on_its_width():
    codes = np.array([ord(c) for c in "it's  a 'test'  of 12 \n things" * 40] + [0x110000], np.uint32)
    kinds = bpe.position_classes(codes)
    state, slow = bpe.FRESH, []
    for k in kinds:
        slow.append(state)
        state = bpe._step(state, int(k))[0]
    for width in (1, 7, 256):
        assert bpe.scan_states(kinds, width).tolist() == slow


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in QUERIES["op6_byte_bpe"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        ids = library.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_odd_rows(spark, odd, none):
    rows = bpe.encode_texts(odd, PATH).collect()
    assert len(rows) == 11 and sum(r["n_tokens"] == 0 for r in rows) == 3
    assert all(len(r["offsets"]) == r["n_tokens"] for r in rows)
    assert bpe.encode_texts(none, PATH).count() == 0

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from spanforge.llm import alignment
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SIGNS = list("ab'sstmdrevlEé1²  \n\t!.-xñ\r٣中\x1c　\U0001f600İΣς̸́<|>\xa0​한가\x00▁")
SIGNS += ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", " the", " word ", "   "]


def brute(docs):
    """Rows by the two libraries, all pairs of each group spelled out."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    per, held = [], Counter()
    for d, t in docs:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        a_bytes, b_bytes = [bytes(signs[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            a = b = a_bytes = b_bytes = []
        a_ends, b_ends = (np.cumsum([len(x) for x in s]).tolist() for s in (a_bytes, b_bytes))
        groups, links = [], Counter()
        x, y = 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i, j = a_ends.index(end, x) + 1, b_ends.index(end, y) + 1
            groups.append((a[x:i], b[y:j]))
            links.update((p, q) for p in a[x:i] for q in b[y:j])
            x, y = i, j
        held.update(links.keys())
        per.append((d, a, b, groups, links))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for d, a, b, groups, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if held[p] == top[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((d, len(a), len(b), len(groups), sum(links.values()), best, total, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


@pytest.fixture
def small_units(monkeypatch):
    for name, value in {"PORTION": 3_000, "PART_CHARS": 9_000, "PART_PAIRS": 500, "PAIRS": 50, "SMALL": 6}.items():
        monkeypatch.setattr(alignment, name, value)


def test_pieces_are_those_of_the_library():
    own = alignment.PieceEncoder(B, cache=300)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(0, 60))) for _ in range(3_000)]
    texts += ["", " ", "  ", "a ", " " * 500, "=" * 3_000]
    assert [np.frombuffer(i, np.int32).tolist() for i in own.encode(texts)] == [own.model.encode(t) for t in texts]


def test_against_both_libraries(spark, small_units):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(SIGNS[:-9] if i % 2 else SIGNS) for _ in range(rnd.randrange(0, 60))) for i in range(500)]
    texts += ["the cat sat on the mat"] * 40 + ["x=" * 900, "ab" * 700, "中文" * 300, ""]
    rows = [*enumerate(texts), (3, None), (None, "x y"), (None, "x y"), (3, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(alignment.align_texts(docs, A, B)) == brute(rows)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert rows_of(QUERIES["op11_alignment"](spark, sf)) == brute(docs)


def test_odd_rows(odd, none, small_units):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(alignment.align_texts(odd, A, B)) == brute(rows)
    assert alignment.align_texts(none, A, B).count() == 0

import zlib

from spanforge.llm import toxicity as tox
from spanforge.llm.queries import QUERIES
from spanforge.llm.shared import table

TERMS = (tox.Term("idiot", False, 1.0, 1), tox.Term("disgusting", False, 1.0, 2), tox.Term("scum", False, 1.0, 0), tox.Term("achlich", True, 0.9, 0))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    automaton = tox.Automaton(TERMS)
    words = ["idiot", "idoit", "id1ot", "idiots", "iidiott", "scum", "scam", "disgustng", "disgussing", "disgostang", "xdisgustingxx", "achlichkeit", "achlic", "", "idio", "z" * 500]
    for w in words:
        want = min(
            ((d, i) for i, t in enumerate(TERMS) if (d := 0 if t.stem and w.startswith(t.text) else distance(w, t.text)) <= t.edits), default=None
        )
        assert automaton.find(w) == want, w
    assert tox.Automaton(()).find("idiot") is None


def test_quotation_counts_less():
    m = tox.Matcher(tox.Model(TERMS))
    abuse, quote = "you are an idiot and scum", 'they said "you are an idiot and scum" there'
    assert m.evidence(abuse)[0] > 2.5 * m.evidence(quote)[0] > 0
    assert m.evidence("the word idiot")[2] == 1
    assert m.evidence("") == (0.0, 0, 0)


def train(spark, n=400):
    clean = [(i, f"plain words number {i} about rivers and hills and trees {i * 7}", 0) for i in range(n)]
    bad = [(n + i, f"note {i} you {['idiot', 'moron', 'stupid'][i % 3]} and {['clown', 'trash'][i % 2]} of {i * 3}", 1) for i in range(n // 4)]
    rows = clean + bad
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_learns_and_catches_misspellings(spark):
    docs, labels = train(spark)
    model = tox.learn(docs, labels)
    assert {"idiot", "moron", "stupid", "clown", "trash"} <= {t.text for t in model.terms}
    new = [(1, "you idiot and clown"), (2, "you stupit clwon, trassh"), (3, "rivers and hills"), (4, None), (5, "")]
    got = tox.score_texts(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert [r["predicted"] for r in sorted(got)] == [1, 1, 0, 0, 0]


def test_held_out_labels_are_not_learned(spark):
    docs, labels = train(spark)
    model = tox.learn(docs, labels)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert tox.learn(docs, flipped) == model


def test_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (empty, nulls):
        model = tox.learn(odd, labels)
        got = tox.score_texts(odd, model).collect()
        assert len(got) == 11 and {r["predicted"] for r in got} == {0}
    assert tox.score_texts(none, tox.Model(TERMS)).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) > 0.9


def test_texts_that_only_begin_or_end_alike_all_count(spark):
    head, foot = "an opening of more than forty characters in all texts. ", " this text is given under a licence of more than forty characters"
    n = 120
    rows = [(i, f"{head}plain words {i} about rivers {i * 7} and hills {i * 11} and trees{foot}", 0) for i in range(n)]
    rows += [(n + i, f"{head}note {i} you {['idiot', 'moron'][i % 2]} of {i * 3} and more {i * 5}{foot}", 1) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    sample = tox.training_sample(docs, labels, tox.Params(), "doc_id", "text").collect()
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in rows)
    assert {"idiot", "moron"} <= {t.text for t in tox.learn(docs, labels).terms}


def test_copies_count_once_and_take_no_place(spark):
    long = " ".join(f"word{k}" for k in range(100))
    texts = [long, long.upper(), long + " end", "start " + long] + [f"{i} text {i * 3} of {i * 7} its {i * 9} own" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([long] * 60 + texts)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    held = [i for i in range(60, 60 + len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    own = sum(i >= 64 and i not in held for i in range(60, 60 + len(texts)))
    sample = tox.training_sample(docs, labels, tox.Params(), "doc_id", "text").collect()
    assert len(sample) == own + 1 and sum("word99" in r["_text"].lower() for r in sample) == 1
    few = tox.training_sample(docs, labels, tox.Params(toxic_rows=20), "doc_id", "text").collect()
    assert len(few) >= 17  # 60 equal texts take one place, not most of the twenty


def test_inflected_terms_catch_misspellings(spark):
    clean = [(i, f"plain words number {i} about rivers and hills and trees {i * 7}", 0) for i in range(400)]
    bad = [(400 + i, f"note {i} you {'idiot' if i % 5 < 3 else 'idiots'} of {i * 3}", 1) for i in range(125)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in clean + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in clean + bad], "doc_id long, quality int, toxic int")
    model = tox.learn(docs, labels)
    assert any(t.stem and t.text == "idio" for t in model.terms)
    found = tox.Matcher(model).words("idiot idiots idiotic id1ot ixdiot idi0ts rivers")
    assert {"idiot", "idiots", "idiotic", "id1ot", "ixdiot", "idi0ts"} == found.keys()
    assert {w for w, (edits, _) in found.items() if edits == 0} == {"idiot", "idiots", "idiotic"}


def test_words_beside_a_stem_come_beyond_the_bound():
    rows = [{"term": t, "pos": n, "neg": 0} for t, n in (("idio", 100), ("scum$", 90), ("idiot$", 60), ("idiots$", 40))]
    got = tox._choose(rows, tox.Params(max_terms=2))
    assert [(t.text, t.stem, t.edits) for t in got] == [("idio", True, 0), ("scum", False, 0), ("idiot", False, 1), ("idiots", False, 1)]
    automaton = tox.Automaton(tuple(got))
    assert automaton.find("idiotx") == (0, 0)  # the exact beginning goes before a misspelt word

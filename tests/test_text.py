import pytest
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators import joins
from spanforge.operators import parsing as ps


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    return [r.out for r in df.select("i", fn(F.col("t")).alias("out")).orderBy("i").collect()]


def test_counts(spark):
    texts = ["One two.  Three!", "", None, "  \t", "a..b?", "no end", "x　y"]
    assert column(spark, texts, text.word_count) == [3, 0, 0, 0, 1, 2, 2]
    assert column(spark, texts, text.sentence_count) == [2, 0, 0, 0, 2, 1, 1]


def test_split_sentences(spark):
    got = column(spark, ["A b. C d?  E! ", "v1.2 is out. Yes", ""], text.split_sentences)
    assert got == [["A b.", "C d?", "E!"], ["v1.2 is out.", "Yes"], []]


def test_strip_thinking(spark):
    raw = ["<think>a\nb</think> Shot 1", " <THINK>never closed", None, "", "x <think>y</think> z <think>w</think>"]
    assert column(spark, raw, text.strip_thinking) == ["Shot 1", "", None, "", "x  z"]


def test_soften_and_markers(spark):
    assert column(spark, ["A Child saw blood; skill"], text.soften_text) == ["A young person saw injury; skill"]
    assert column(spark, ["a ASSISTANT: b ASSISTANT: c ", "plain"], text.after_marker) == ["c", "plain"]
    assert column(spark, ["ok", "OK", "Filtered", None], text.encode_status) == [0, 0, 1, 1]


def outputs(spark, rows, schema):
    return spark.createDataFrame([("d", f"v{i}", *r) for i, r in enumerate(rows)], f"dataset string, video_id string, {schema}")


@pytest.mark.parametrize(
    "raw,n,ranking,reason",
    [
        ("Shot 2 > shot 1 > Shot  3", 3, [2, 1, 3], None),
        ("2 > 1 > 3", 3, [2, 1, 3], None),
        ("Shot 1 > Shot 1 > Shot 2", 2, None, "duplicated_items"),
        ("Shot 1", 2, None, "missing_items"),
        ("Shot 1 > Shot 2 > Shot 3", 2, None, "wrong_format"),
        (" \n", 2, None, "empty_output"),
        (None, 2, None, "empty_output"),
        ("no idea", 2, None, "wrong_format"),
        ("Shot 99999999999999999999 > Shot 1 > Shot 2", 2, None, "wrong_format"),
    ],
)
def test_reasoned_ranking(spark, raw, n, ranking, reason):
    row = ps.parse_ranking_reasoned(outputs(spark, [(raw, n)], "raw_output string, n_items long")).first()
    assert (row.ranking, row.failure_reason) == (ranking, reason)


def test_sentence_label(spark):
    row = ps.parse_ranking_reasoned(outputs(spark, [("Sentence 2 > Sentence 1", 2)], "raw_output string, n_items long"), "Sentence").first()
    assert row.ranking == [2, 1]


def test_winner(spark):
    raw = ["Shot A", "shot b.", "Shot B beats Shot A", "none", None, "ShotA", "Shots A"]
    assert column(spark, raw, ps.parse_winner) == ["A", "B", "B", None, None, "A", None]


def test_assignments(spark):
    schema = "raw_output string, n_lines long, n_ids long"
    raw = "Summary 1: Clip 2, Clip 5\nSummary 2: none\nSummary 12: Clip 1"
    out = ps.parse_assignments(outputs(spark, [(raw, 3, 4), ("", 1, 4), (None, 1, 4)], schema)).orderBy("video_id").collect()
    first, empty, null = out
    assert [x.ids for x in first.lines] == [[1], [], []]
    assert not first.format_ok and first.nonempty_count == 1
    assert first.failure_reasons == ["no_valid_clip_ids_line_2", "missing_line_3"]
    assert empty.failure_reasons == ["missing_line_1"] and null.failure_reasons == ["missing_line_1"]
    strict = ps.parse_assignments(outputs(spark, [("Summary1: 1", 1, 4), ("Summary 1: 1", 1, 4), ("Summary 1:", 1, 4)], schema), strict=True)
    assert [(r.format_ok, r.failure_reasons) for r in strict.orderBy("video_id").collect()] == [
        (False, ["missing Summary 1"]),
        (True, []),
        (False, []),
    ]


def test_index_list(spark):
    rows = [("take [3, 1, 3, 9]", 5, 2), ("[1 2] or 4", 5, 5), ("frames 5 and 5 and 2", 5, 5), ("nothing", 5, 1), ("[7] x [1]", 5, 1)]
    out = ps.parse_index_list(outputs(spark, rows, "raw_output string, n_items long, n_select long")).orderBy("video_id").collect()
    assert [r.selected for r in out] == [[3, 1], [1, 2, 4], [5, 2], [], []]
    assert [r.parse_ok for r in out] == [True, True, True, False, False]


def test_summary_and_frames(spark):
    schema = "raw_output string, n_sentences long, n_frames long, n_select long"
    good = "SUMMARY:\n1. One.\n2. Two.\n\nIMPORTANT FRAMES: [Frame 1, Frame 4, 4, 99]"
    rows = [(good, 2, 10, 2), ("SUMMARY:\nOne. Two. Three.\nIMPORTANT FRAMES: none", 3, 10, 2), ("no sections", 1, 10, 2)]
    a, b, c = ps.parse_summary_and_frames(outputs(spark, rows, schema)).orderBy("video_id").collect()
    assert (a.sentences, a.selected, a.parse_ok, a.failure_reason) == (["One.", "Two."], [1, 4], True, None)
    assert b.sentences == ["One.", "Two.", "Three."] and b.failure_reason == "no_valid_frame_numbers"
    assert c.failure_reason == "no_summary_section; no_frames_section" and not c.parse_ok


def test_aligned_document(spark):
    doc = "[Shots 0-2] First.\n\n[Shot 7] Second (Note: x).\nNote: y\n\nNote: z\n\n[Shot 8 is missing]"
    df = spark.createDataFrame([("d", doc)], "id string, document string")
    cleaned = df.withColumn("document", ps.clean_generated_text(F.col("document")))
    rows = ps.parse_aligned_document(cleaned).orderBy("sentence_id").collect()
    assert [(r.text, r.shot_ids) for r in rows] == [("First.", [0, 1, 2]), ("Second.", [7])]
    untagged = ps.parse_aligned_document(spark.createDataFrame([("d", "plain")], "id string, document string")).first()
    assert (untagged.text, untagged.shot_ids) == ("plain", [])


def test_nearest_fill_prefers_the_earlier_caption(spark):
    rows = [("d", "v", s, t, st) for s, (t, st) in enumerate([("a", 0), ("?", 1), ("b", 0), ("?", 1), ("?", 1), ("?", 1), ("c", 0)])]
    rows += [("d", "w", 0, "?", 1)]
    frames = spark.createDataFrame(rows, "dataset string, video_id string, step long, description string, status int")
    out = joins.nearest_valid_fill(frames).orderBy("video_id", "step").collect()
    assert [r.filled for r in out] == ["a", "a", "b", "b", "b", "c", "c", "No description available"]


def test_printed_documents_are_read(spark):
    from spanforge.sources.records import parse_nested_docs

    doc = r"""{"aligned_text_summary": "{'raw_text': None, 'sentences': ['It\\'s a', \"None, he said\"], 'alignments': [{'sentence_id': 0, 'shot_ids': [3]}], 'num_sentences': 2}"}"""
    parts = parse_nested_docs(spark.createDataFrame([("d", "v", doc)], "dataset string, video_id string, doc string"))
    assert [(r.text, r.shot_ids) for r in parts["sentences"].orderBy("sentence_id").collect()] == [("It's a", [3]), ("None, he said", [])]
    assert parts["documents"].first().raw_text == "It's a None, he said"

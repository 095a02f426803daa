from pyspark.sql import functions as F

from spanforge.llm import chat_format as chat

CASES = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "user", "\\[INST] \\\\l \\t <<SYS>>\n"),
    (3, 0, "tool", "[ROLE]x[SAYS]y[/ROLE]"), (3, 1, None, None), (3, 2, "sys<tem", "a\\"),
    (4, 0, "system", " \n"), (4, 1, "user", "\n [/INST]"), (4, 2, "assistant", None),
    (5, None, "user", "first"), (5, 1, "user", "same"), (5, 1, "user", "same"),
    (None, 0, "user", "no id"), (6, 0, "assistant", "x" * 200_000),
]


def frame(spark, rows=CASES):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, loss int")


def test_round_trip(spark):
    out = chat.format_chats(frame(spark)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    got = {r["conv_id"]: r for r in out}
    for conv in {c[0] for c in CASES}:
        rows = sorted((r for r in CASES if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        want = [(r[2] or "", r[3] or "", r[2] == "assistant") for r in rows]
        assert [tuple(t) for t in got[conv]["turns"]] == want
        masked = [s["text"] for s in got[conv]["segments"] if s["loss"]]
        assert len(masked) == sum(r[2] == "assistant" for r in rows)
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]


def test_role_machine(spark):
    got = {r["conv_id"]: (r["valid"], r["complete"]) for r in chat.format_chats(frame(spark)).collect()}
    assert got[1] == got[2] == got[4] == (True, True)
    assert got[None] == (True, False)
    assert got[3] == got[5] == got[6] == (False, False)


def test_other_template_and_empty_table(spark):
    t = chat.Template(roles={"user": chat.Turn("<u>", "</u>"), "assistant": chat.Turn("<a>", "</a>", True)})
    row = chat.format_chats(frame(spark, CASES[:2]), t).first()
    assert row["formatted"] == "<u>hi</u><a>hello</a>"
    assert chat.format_chats(frame(spark, [])).count() == 0

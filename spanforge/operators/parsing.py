"""Raw model answers and generated documents to tables.

Each job adds parsed columns to the answer rows; ``explode_predictions`` turns the parsed
ids into the long ``predictions`` table. All pattern work runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators.ordered import KEYS
from spanforge.operators.sampling import dedup_keep_first



def upto(n: Column) -> Column:
    """The ids 1..n."""
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )


def missing_ids(ids: Column, n: Column) -> Column:
    """Ids of 1..n that were not named."""
    return F.array_except(upto(n), ids)


def _strangers(ids: Column, n: Column) -> Column:
    return F.exists(ids, lambda x: x.isNull() | (x < 1) | (x > n))


def parse_ranking_reasoned(outputs: DataFrame, label: str = "Shot") -> DataFrame:
    """``label X > label Y``, else bare integers; ``ranking`` or a ``failure_reason``."""
    raw, n = F.col("raw_output"), F.col("n_items")
    named = text.integers(raw, rf"(?i){label}\s+(\d+)", 1)
    ids = F.when(F.size(named) > 0, named).otherwise(text.integers(raw, r"\b(\d+)\b", 1))
    out = outputs.withColumn("_ids", ids)
    ids = F.col("_ids")
    reason = (
        F.when(text.is_blank(raw), "empty_output")
        .when(F.size(ids) == 0, "wrong_format")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicated_items")
        .when(F.size(missing_ids(ids, n)) > 0, "missing_items")
        .when(_strangers(ids, n), "wrong_format")
    )
    out = out.withColumn("failure_reason", reason)
    return out.withColumn("ranking", F.when(F.col("failure_reason").isNull(), ids)).drop("_ids")


def parse_ranking_strict(outputs: DataFrame, label: str = "Shot") -> DataFrame:
    """``label X > ...`` with repeats removed; NULL unless it is a permutation of 1..n."""
    n = F.col("n_items")
    out = outputs.withColumn("_ids", F.array_distinct(text.integers(F.col("raw_output"), rf"(?i){label}\s+(\d+)", 1)))
    ids = F.col("_ids")
    good = (F.size(ids) == n) & (F.size(missing_ids(ids, n)) == 0)
    return out.withColumn("ranking", F.when(good, ids)).drop("_ids")


def parse_winner(raw: Column) -> Column:
    """A or B; when both are named the first one; NULL when neither is."""
    first = F.upper(F.regexp_extract(raw, r"(?i)\bShot\s*([AB])\b", 1))
    return F.nullif(first, F.lit(""))


def parse_assignments(
    outputs: DataFrame, head: str = r"Summary\s*", unit: str = "clip", strict: bool = False
) -> DataFrame:
    """``Summary K: Clip a, Clip b`` for K = 1..n_lines to 0-based ids per line.

    Adds ``lines`` (one struct per K with ``ids`` and ``reason``), ``nonempty_count``, ``format_ok`` and
    ``failure_reasons``. ``n_ids`` bounds the ids. ``strict`` asks for white space before K, ends a line only at
    the next complete head, and accepts the format only when every line names an id.
    """
    raw = F.col("raw_output")
    if strict:
        head = head.removesuffix("*") + "+"
        stop, body = rf"{head}\d+\s*:", "(.*?)"
    else:
        stop, body = rf"{head}\d", "(.+?)"
    # The body is captured ahead of the match, so one pass finds every head, also inside the body of another.
    pattern = F.lit(rf"(?is){head}(\d+)(?=\s*:\s*{body}(?={stop}|$))")
    every = [F.regexp_extract_all(raw, pattern, F.lit(i)).alias(n) for i, n in ((1, "k"), (2, "part"))]
    outputs = outputs.withColumn("_h", F.arrays_zip(*every))

    def part(k: Column) -> Column:
        first = F.get(F.filter("_h", lambda h: h["k"] == k.cast("string")), F.lit(0))
        return F.struct(k.alias("k"), F.coalesce(first["part"], F.lit("")).alias("part"), first.isNotNull().alias("hit"))

    def line(x: Column) -> Column:
        present = x["hit"] if strict else x["part"] != ""
        ids = F.transform(
            F.filter(text.integers(x["part"]), lambda i: (i >= 1) & (i <= F.col("n_ids"))), lambda i: i - 1
        )
        return F.struct(x["k"].alias("k"), F.coalesce(present, F.lit(False)).alias("present"), ids.alias("ids"))

    out = outputs.withColumn("_l", F.transform(F.transform(upto(F.col("n_lines")), part), line))
    missing = "missing Summary " if strict else "missing_line_"

    def reason(x: Column) -> Column:
        absent = F.concat(F.lit(missing), x["k"].cast("string"))
        if strict:
            return F.when(~x["present"], absent)
        return F.when(~x["present"], absent).when(
            F.size(x["ids"]) == 0, F.concat(F.lit(f"no_valid_{unit}_ids_line_"), x["k"].cast("string"))
        )

    lines = F.transform(
        "_l",
        lambda x: F.struct(
            x["k"].alias("k"),
            F.coalesce(x["ids"], F.array().cast("array<bigint>")).alias("ids"),
            reason(x).alias("reason"),
        ),
    )
    out = out.withColumn("all_present", F.forall("_l", lambda x: x["present"])).withColumn("lines", lines)
    nonempty = F.size(F.filter("lines", lambda x: F.size(x["ids"]) > 0)).cast("long")
    failures = F.array_compact(F.transform("lines", lambda x: x["reason"]))
    out = out.withColumns({"nonempty_count": nonempty, "failure_reasons": failures})
    ok = F.col("all_present") & (F.col("nonempty_count") == F.col("n_lines")) if strict else F.col("all_present")
    return out.withColumn("format_ok", ok).drop("_l", "_h", "all_present")


def assignment_rows(parsed: DataFrame) -> DataFrame:
    """One row per answered line and id; ``display_pos`` is the line number.

    The outer forms keep Spark from testing for empty lists ahead of them, which would parse every answer again.
    """
    lines = parsed.select(*KEYS, F.explode_outer("lines").alias("l"))
    named = lines.select(*KEYS, F.col("l.k").alias("display_pos"), F.posexplode_outer("l.ids").alias("_p", "pred_id"))
    return named.filter(F.col("_p").isNotNull()).drop("_p")


def parse_candidates(outputs: DataFrame) -> DataFrame:
    """``Candidate Doc K: Clip a`` lines, parsed as assignments."""
    return parse_assignments(outputs, head=r"Candidate\s+Doc\s*")


def parse_index_list(outputs: DataFrame) -> DataFrame:
    """The first bracketed list, else all integers: in range, first mention, first n_select."""
    raw = F.col("raw_output")
    bracket = F.regexp_extract(raw, r"\[[\d,\s]+\]", 0)
    listed = F.regexp(bracket, F.lit(r"^\[\s*(?:0|[1-9]\d*)(?:\s*,\s*(?:0|[1-9]\d*))*\s*\]$"))
    ids = F.when(listed, text.integers(bracket)).otherwise(text.integers(raw, r"\b\d+\b"))
    out = outputs.withColumn("_all", dedup_keep_first(ids, 1, F.col("n_items")))
    cut = F.slice("_all", F.lit(1), F.col("n_select").cast("int"))
    return out.withColumns({"selected": cut, "parse_ok": F.size("_all") > 0}).drop("_all")


def _frame_list(raw: Column, gap: str) -> Column:
    part = F.regexp_extract(raw, rf"(?i)IMPORTANT{gap}FRAMES\s*:\s*\[?([^\]\n]+)\]?", 1)
    return dedup_keep_first(text.integers(part), 1, F.col("n_frames"))


def _two_level(out: DataFrame, block: Column) -> DataFrame:
    """Lines of a summary block, or its sentences when there are fewer lines than asked."""
    n = F.col("n_sentences")
    out = out.withColumn("_c", text.drop_bullets(text.lines(block)))
    out = out.withColumn("_s", text.split_sentences(F.array_join("_c", " ")))
    enough = F.size("_c") >= n
    longer = F.when(F.size("_s") >= F.size("_c"), F.col("_s")).otherwise(F.col("_c"))
    chosen = F.when(enough, F.slice("_c", F.lit(1), n.cast("int"))).when(F.size("_c") > 0, longer)
    chosen = F.coalesce(chosen, F.array().cast("array<string>"))
    mode = F.when(enough, "line").when(F.size("_c") > 0, "sentence_fallback")
    return out.withColumns({"sentences": chosen, "parse_mode": mode}).drop("_c", "_s")


def parse_summary_and_frames(outputs: DataFrame) -> DataFrame:
    """SUMMARY and IMPORTANT FRAMES sections; good as soon as frames were read.

    ``n_sentences``, ``n_frames`` and ``n_select`` come with the row; a wrong number of frames is only noted.
    """
    raw = F.col("raw_output")
    section = r"(?is)SUMMARY\s*:\s*\n(.*?)(?=(?:TASK\s*2|IMPORTANT\s*FRAMES)|$)"
    has_summary = F.regexp(raw, F.lit(section))
    has_frames = F.regexp(raw, F.lit(r"(?i)IMPORTANT\s*FRAMES\s*:\s*\[?([^\]\n]+)\]?"))
    out = _two_level(outputs, F.when(has_summary, F.regexp_extract(raw, section, 1)))
    out = out.withColumn("selected", F.when(has_frames, _frame_list(raw, r"\s*")).otherwise(F.array().cast("array<bigint>")))
    got = F.size("selected")
    mismatch = F.concat(
        F.lit("frames_count_mismatch(got="), got.cast("string"), F.lit(",expected="), F.col("n_select").cast("string"), F.lit(")")
    )
    second = (
        F.when(~has_frames, "no_frames_section")
        .when(got == 0, "no_valid_frame_numbers")
        .when(got != F.col("n_select"), mismatch)
    )
    reasons = F.array_compact(F.array(F.when(~has_summary, "no_summary_section"), second))
    return out.withColumns(
        {
            "parse_ok": got > 0,
            "failure_reason": F.nullif(F.array_join(reasons, "; "), F.lit("")),
        }
    ).drop("parse_mode")


def parse_summary_with_frames(outputs: DataFrame) -> DataFrame:
    """The joint form: numbered lines (else all lines) and frames; good only with both."""
    raw = F.col("raw_output")
    block = text.strip(F.regexp_extract(raw, r"(?is)SUMMARY\s*:[^\S\n]*\n?(.*?)(?=IMPORTANT FRAMES|$)", 1))
    numbered = F.regexp_extract_all(block, F.lit(r"(?md)^\d+\.\s*(.+?)$"), F.lit(1))
    numbered = F.filter(F.transform(numbered, text.strip), lambda s: s != "")
    out = outputs.withColumn("_n", numbered).withColumn("_l", text.lines(block))
    out = out.withColumn("sentences", F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.col("_l")))
    out = out.withColumn("selected", _frame_list(raw, " "))
    return out.withColumn("parse_ok", (F.size("sentences") > 0) & (F.size("selected") > 0)).drop("_n", "_l")


def parse_summary(outputs: DataFrame) -> DataFrame:
    """SUMMARY section only, with the parse mode and the reason of a mismatch."""
    raw, n = F.col("raw_output"), F.col("n_sentences")
    section = r"(?is)SUMMARY\s*:\s*\n?(.*)"
    found = F.regexp(raw, F.lit(section))
    out = _two_level(outputs, F.when(found, F.regexp_extract(raw, section, 1)))
    got = F.size("sentences")
    mismatch = F.concat(
        F.lit("sentence_count_mismatch(got="), got.cast("string"), F.lit(",expected="), n.cast("string"), F.lit(")")
    )
    reason = (
        F.when(~found, "no_summary_section")
        .when(got == 0, "empty_summary_block; no_sentences_extracted")
        .when(got != n, mismatch)
    )
    return out.withColumns({"parse_ok": got > 0, "failure_reason": reason})


def parse_thirds(raw: Column) -> dict[str, Column]:
    """The three described thirds; '' for a missing one."""
    part = lambda p: text.strip(F.regexp_extract(raw, p, 1))
    return {
        "first_third": part(r"(?is)FIRST THIRD\s*:\s*(.+?)(?=MIDDLE THIRD|LAST THIRD|$)"),
        "middle_third": part(r"(?is)MIDDLE THIRD\s*:\s*(.+?)(?=LAST THIRD|$)"),
        "last_third": part(r"(?is)LAST THIRD\s*:\s*(.+)"),
    }


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), text.strip), lambda p: p != "")


def clean_generated_text(c: Column) -> Column:
    """Keep tagged paragraphs with content, without trailing notes."""
    tagged = F.filter(paragraphs(c), lambda p: F.regexp(p, F.lit(r"(?i)\A\[Shots?\s+\d+")))
    absent = r"(?i)is missing|missing from|not (provided|available|given)"
    kept = F.filter(tagged, lambda p: ~F.regexp(F.substring(p, 1, 80), F.lit(absent)))

    def bare(p: Column) -> Column:
        p = F.regexp_replace(p, r"(?is)\s*\(Note[:\s][^)]*\)", "")
        return text.strip(F.regexp_replace(p, r"(?is)\s*\n\s*Note[:\s].*", ""))

    return F.array_join(F.filter(F.transform(kept, bare), lambda p: p != ""), "\n\n")


def parse_aligned_document(docs: DataFrame, column: str = "document") -> DataFrame:
    """``[Shots X-Y] text`` paragraphs to sentences with shot ids; untagged ones get none."""
    rows = docs.select("*", F.posexplode(paragraphs(F.col(column))).alias("sentence_id", "_p"))
    pattern = r"(?is)\A\[Shots?\s+(\d+)(?:-(\d+))?\]\s*(.*)"
    tagged = F.regexp("_p", F.lit(pattern))
    first = F.regexp_extract("_p", pattern, 1).try_cast("bigint")
    last = F.coalesce(F.nullif(F.regexp_extract("_p", pattern, 2), F.lit("")).try_cast("bigint"), first)
    ids = F.when(tagged & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    said = F.when(tagged, text.strip(F.regexp_extract("_p", pattern, 3))).otherwise(F.col("_p"))
    return rows.withColumns(
        {"sentence_id": F.col("sentence_id").cast("long"), "text": said, "shot_ids": ids}
    ).drop("_p", column)


def parse_first_index(raw: Column, n: Column) -> tuple[Column, Column]:
    """(0-based index, ok): the first integer in 1..n, else the middle and not ok."""
    first = F.nullif(F.regexp_extract(raw, r"\b(\d+)\b", 1), F.lit("")).try_cast("bigint")
    ok = F.coalesce((first >= 1) & (first <= n), F.lit(False))
    return F.when(ok, first - 1).otherwise(F.floor(n / 2)).cast("long"), ok


def explode_predictions(parsed: DataFrame, ids: str = "ranking") -> DataFrame:
    """``pos`` (1-based) and ``pred_id`` of every parsed answer; outer as in :func:`assignment_rows`."""
    listed = parsed.select(*KEYS, F.posexplode_outer(ids).alias("_p", "pred_id")).filter(F.col("_p").isNotNull())
    return listed.select(*KEYS, (F.col("_p") + 1).cast("long").alias("pos"), "pred_id")

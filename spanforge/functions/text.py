"""Column functions on text; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters treated as white space, inside a class of a (?U) pattern.
SPACES = r"\s\x1c-\x1f"

# Words softened before a request, in order.
SOFTER_WORDS = [
    (r"\b(child|boy|girl|kid|toddler)\b", "young person"),
    (r"\b(shirtless|topless|bare-chested)\b", "lightly clothed"),
    (r"\b(nude|nudity|naked)\b", "person with exposed body"),
    (r"\b(sex|sexual|sexually)\b", "intimate"),
    (r"\b(porn|pornography)\b", "explicit media"),
    (r"\b(rape|raped)\b", "sexual assault"),
    (r"\b(suicide|suicidal)\b", "self-harm related"),
    (r"\b(self-harm|self harm)\b", "self-injury"),
    (r"\b(kill|killing|killed)\b", "harm"),
    (r"\b(murder|murdered)\b", "violent harm"),
    (r"\b(gore|gory)\b", "graphic injury"),
    (r"\b(blood|bloody)\b", "injury"),
]

# Text of a filtered caption, of a caption without any valid neighbour, and the
# error markers of a filtered request.
FILTERED = "[CONTENT_FILTERED]"
NO_DESCRIPTION = "No description available"
FILTER_MARKERS = ["content_filter", "responsibleaipolicyviolation"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{SPACES}]+|[{SPACES}]+\z", "")


def is_blank(c: Column) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(~F.regexp(c, F.lit(rf"(?U)[^{SPACES}]")), F.lit(True))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(rf"(?U)[^{SPACES}]+")), F.lit(0)).cast("long")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?U)[^{SPACES}]+"), F.lit(0))


def sentence_count(c: Column) -> Column:
    """Pieces between runs of ``.!?`` that hold more than white space."""
    piece = rf"(?U)[^.!?]*?[^.!?{SPACES}][^.!?]*"
    return F.coalesce(F.regexp_count(c, F.lit(piece)), F.lit(0)).cast("long")


def split_sentences(c: Column) -> Column:
    """Sentences split at white space behind ``.``, ``!`` or ``?``."""
    parts = F.split(strip(c), rf"(?U)(?<=[.!?])[{SPACES}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def lines(c: Column) -> Column:
    """Trimmed non-blank lines."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s != "")


def drop_bullets(items: Column) -> Column:
    """Remove leading numbers and bullet marks; drop lines that held nothing else."""
    bare = F.transform(items, lambda s: F.regexp_replace(s, rf"(?U)^(?:\d+[.)]|[-*•])[{SPACES}]*", ""))
    return F.filter(bare, lambda s: s != "")


def integers(c: Column, pattern: str = r"\d+", group: int = 0) -> Column:
    """Numbers in order of appearance; digit runs too long for an int64 become NULL."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda s: s.try_cast("bigint"))


def strip_thinking(c: Column) -> Column:
    """Remove thinking blocks and an unclosed leading one; NULL stays NULL."""
    closed = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    opened = F.regexp_replace(closed, r"(?is)^\s*<think>.*", "")
    return F.when(c == "", c).otherwise(strip(opened))


def soften_text(c: Column) -> Column:
    for pattern, softer in SOFTER_WORDS:
        c = F.regexp_replace(c, f"(?i){pattern}", softer)
    return c


def is_content_filtered(error: Column) -> Column:
    low = F.lower(error)
    hit = F.lit(False)
    for marker in FILTER_MARKERS:
        hit = hit | low.contains(marker)
    return F.coalesce(hit, F.lit(False))


def after_marker(c: Column, marker: str = "ASSISTANT:") -> Column:
    return strip(F.substring_index(c, marker, -1))


def valid_text(c: Column) -> Column:
    """True for text that can be shown: not NULL, not blank, not filtered."""
    return ~is_blank(c) & (c != FILTERED) & (c != "NaN")


def encode_status(c: Column) -> Column:
    """0 for OK in any case, else 1 (also for NULL)."""
    return F.when(F.upper(c) == "OK", 0).otherwise(1)


def normalize_id(c: Column) -> Column:
    return F.regexp_replace(c, r"video(\d+)", "video_$1")

"""Chat formatting: a role machine, a declarative template and loss flags, all in built-in functions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import literal_map, text_or_empty

# Control strings of the template may only begin with these characters; texts are escaped so that
# they contain neither.
OPENERS = {"[": "l", "<": "t"}
ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks of each role, marks of any other role, and the role machine.

    ``steps`` maps (state, role) to the next state; a missing step ends in ``bad``. A conversation is valid if it
    never gets there, and complete if it ends in one of ``final``.
    """

    roles: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("[ANS] ", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    start: str = "start"
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = [m for t in self.roles.values() for m in (t.open, t.close)] + list(self.other)
        if any(not m.lstrip()[:1] or m.lstrip()[0] not in OPENERS for m in marks):
            raise ValueError(f"a mark must begin with one of {sorted(OPENERS)}, after white space at most")


def escape(text: Column) -> Column:
    """Reversible: afterwards no opener of a control string is left in the text."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "b"))
    for opener, letter in OPENERS.items():
        out = F.replace(out, F.lit(opener), F.lit(ESCAPE + letter))
    return out


def unescape(text: Column) -> Column:
    out = text
    for opener, letter in OPENERS.items():
        out = F.replace(out, F.lit(ESCAPE + letter), F.lit(opener))
    return F.replace(out, F.lit(ESCAPE + "b"), F.lit(ESCAPE))


def _pieces(turn: Column, template: Template) -> Column:
    """The text segments of one turn: mark, text, mark."""

    def seg(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    text, a, b, c = escape(turn["text"]), *template.other
    out = F.array(
        seg(F.concat(F.lit(a), escape(turn["role"]), F.lit(b)), False), seg(text, False), seg(F.lit(c), False)
    )
    for role, t in template.roles.items():
        own = F.array(seg(F.lit(t.open), False), seg(text, t.loss), seg(F.lit(t.close), False))
        out = F.when(turn["role"] == role, own).otherwise(out)
    return out


def _state(roles: Column, template: Template) -> Column:
    steps = literal_map({f"{a}\n{r}": b for (a, r), b in template.steps.items()})
    move = lambda s, r: F.coalesce(F.element_at(steps, F.concat(s, F.lit("\n"), r)), F.lit("bad"))
    return F.aggregate(roles, F.lit(template.start), move)


def format_chats(
    rows: DataFrame,
    template: Template | None = None,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: key, segments array<(text, loss)>, formatted, valid, complete.

    Null texts and roles are empty. Rows with a null key form one conversation. Turns are sorted by ``order``
    (null first), ties by role and text; repeated rows are repeated turns. A role that the template does not
    name is written with the general marks and makes the conversation invalid. No input, no rows. Other
    input columns are ignored. A conversation is one output row and has to fit one, as in any sink.
    """
    template = template or Template()
    turn = F.struct(
        F.col(order).alias("at"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        text_or_empty(text).alias("text"),
    )
    turns = rows.select(F.col(key), turn.alias("_turn")).groupBy(key)
    turns = turns.agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    state = _state(F.transform("_turns", lambda t: t["role"]), template)
    out = turns.select(
        key,
        F.flatten(F.transform("_turns", lambda t: _pieces(t, template))).alias("segments"),
        state.alias("_state"),
    )
    return out.select(
        key,
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("_state") != "bad").alias("valid"),
        F.col("_state").isin(*template.final).alias("complete"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """array<(role, text, loss)> read back from formatted text alone."""
    template = template or Template()
    body = "([^" + re.escape("".join(OPENERS)) + "]*)"
    a, b, c = map(re.escape, template.other)
    kinds = [(r, t.loss, re.escape(t.open) + body + re.escape(t.close)) for r, t in template.roles.items()]
    other = a + body + b + body + c
    whole = "|".join([k[2] for k in kinds] + [other])
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)({whole})"), 0)

    def turn(text: Column, role: Column, loss: bool) -> Column:
        return F.struct(role.alias("role"), unescape(text).alias("text"), F.lit(loss).alias("loss"))

    def read(t: Column) -> Column:
        out = turn(F.regexp_extract(t, f"(?s)^{other}$", 2), unescape(F.regexp_extract(t, f"(?s)^{other}$", 1)), False)
        for role, loss, _ in kinds:
            mark = template.roles[role]
            n = len(mark.open) + len(mark.close)
            inner = F.substring(t, F.lit(len(mark.open) + 1), F.char_length(t) - n)
            out = F.when(F.startswith(t, F.lit(mark.open)), turn(inner, F.lit(role), loss)).otherwise(out)
        return out

    return F.transform(found, read)

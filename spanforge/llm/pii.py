"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.shared import map_texts

# The base patterns. The look-behinds change no match; they keep a long run of digits
# from being tried from each of its places. Addresses are found from their @ for the same reason.
EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Added kinds.
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IBAN_GROUP = re.compile(r"[ ]?[A-Z0-9]+")
IBAN_SIZES = (15, 34)
# Characters of an account number by country; those of other countries are found by their checksum alone.
IBAN_LENGTH = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.5}
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|adresse)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|payment|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|call|tel|mobile|fax|telefon)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|order|isbn|serial|example|invoice|section)\b", re.I)


@dataclass(frozen=True)
class Params:
    window: int = 40  # characters of context on each side
    lift: float = 0.2
    drop: float = 0.3


def luhn(digits: str) -> bool:
    """The Luhn check over a string of digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The remainder check of international account numbers."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in EMAIL_HEAD:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: upper-case words and numbers may follow one, so it may end at any border of a group.

    The length of the country is tried first, then the longest end, and for countries without a known length all others.
    """
    done = 0
    for m in IBAN_HEAD.finditer(text):
        if m.start() < done:
            continue
        code, at, ends = m[0], m.end(), {}
        while len(code) <= IBAN_SIZES[1] and (group := IBAN_GROUP.match(text, at)):
            code, at = code + group[0].lstrip(" "), group.end()
            if IBAN_SIZES[0] <= len(code) <= IBAN_SIZES[1] and not "a" <= text[at : at + 1] <= "z":
                ends[len(code)] = at
        sizes = sorted(ends, reverse=True)
        own = IBAN_LENGTH.get(m[0][:2])
        for n in sizes if own is None else [*([own] if own in ends else []), *sizes[:1]]:
            if mod97(code[:n]):
                done = ends[n]
                yield m.start(), done
                break


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted by start and kind; ends are exclusive, in code points."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((*m.span(), "phone"))
    found += [(a, b, "iban") for a, b in _ibans(text)]
    found += [(*m.span(), "ssn") for m in SSN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def score(text: str, span: tuple[int, int, str], p: Params) -> float:
    a, b, kind = span
    around = text[max(0, a - p.window) : a] + " " + text[b : b + p.window]
    value = PRIOR[kind] + p.lift * bool(CONTEXT[kind].search(around)) - p.drop * bool(AGAINST.search(around))
    return round(min(1.0, max(0.0, value)), 4)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    params: Params | None = None,
    masked: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: key (or the columns ``keep``), n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, n_likely[, masked_text].

    ``spans`` lists kind:start:end of all spans by start, then kind; ``scores`` belongs to it item by item;
    ``n_likely`` counts scores of 0.5 or more. Each text is read on its own and whole, in one pass per kind.
    Null and empty texts have no spans. Repeated rows, ties and null keys stay rows of their own; an empty table
    gives no rows; other columns are ignored.
    """
    p = params or Params()
    added = {f"n_{k}": pa.int64() for k in BASE} | {"base_sha256": pa.string(), "spans": pa.string()}
    added |= {"scores": pa.list_(pa.float64()), "n_likely": pa.int64()} | ({"masked_text": pa.string()} if masked else {})

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in added}
        for t in texts:
            spans = find_spans(t)
            base = [s for s in spans if s[2] in BASE]
            scores = [score(t, s, p) for s in spans]
            for k in BASE:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
            out["spans"].append(_join(spans))
            out["scores"].append(scores)
            out["n_likely"].append(sum(x >= 0.5 for x in scores))
            if masked:
                out["masked_text"].append(mask(t, spans))
        return out

    return map_texts(docs, keep or [key], text, work, added)

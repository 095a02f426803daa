"""Toxicity: a lexicon learned from labels, matched by Levenshtein automata over its trie, scored in context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.fingerprint import K, sketch
from spanforge.llm.shared import map_texts, text_or_empty
from spanforge.session import checkpoint

WORD = re.compile(r"[^\W_]+(?:[*@$#!]{1,3}[^\W_]+)*")
# Marks that open and close quotations, and words that report or discuss speech.
OPEN_QUOTES, CLOSE_QUOTES = "\"“«„‘", "\"”»“’"
REPORTING = re.compile(
    r"\b(?:said|says|wrote|called|calls|quoted?|quoting|reported|word|words|term|terms|slur|insult|insults|"
    r"sagte|schrieb|nannte|wort|dit|écrit|mot|dijo|escribió|palabra)\b"
)


@dataclass(frozen=True)
class Params:
    """Bounds and factors. The training sample holds at most ``toxic_rows`` and ``clean_rows`` labelled documents."""

    toxic_rows: int = 2_000
    clean_rows: int = 6_000
    max_terms: int = 300
    longest_term: int = 24
    stem: tuple[int, int] = (3, 10)  # lengths of word beginnings that may become terms
    evidence: float = 18.0  # least log-likelihood ratio of a term
    precision: float = 0.8
    stem_precision: float = 0.9
    fuzzy: float = 0.35  # share of a term's weight that a misspelling carries
    chance: float = 0.002  # a term that misspelt clean words come near more often than this is matched exactly
    quoted: float = 0.3  # share that a quoted or reported use carries
    window: int = 60  # characters of context on each side


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any word that begins with it
    weight: float
    edits: int


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...] = ()
    bias: float = -3.0
    slope: float = 8.0
    params: Params = field(default_factory=Params)


class Automaton:
    """The Levenshtein automata of all terms, intersected with the trie of the terms and made deterministic as words need it.

    A state is a set of (trie node, edits so far). Reading a character follows its edge, or spends an edit on a wrong, an extra
    or a missing character; nodes below which no term allows that many edits are left out, so most words die after a few characters.
    """

    def __init__(self, terms: tuple[Term, ...]) -> None:
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]
        for number, term in enumerate(terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], term.edits)
            self.ends[node].append(number)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.match: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.dead = self._state({}) if terms else 0
        self.start = self._state({0: 0}) if terms else 0

    def _state(self, found: dict[int, int]) -> int:
        queue = list(found)
        while queue:  # missing characters
            node = queue.pop()
            spent = found[node] + 1
            for child in self.children[node].values():
                if spent <= self.allowed[child] and spent < found.get(child, 99):
                    found[child] = spent
                    queue.append(child)
        key = frozenset(found.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.next.append({})
            whole = [(e, t) for n, e in key for t in self.ends[n] if e <= self.terms[t].edits]
            self.match.append(min(whole, default=None))
            self.stems.append(min((m for m in whole if self.terms[m[1]].stem), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        found: dict[int, int] = {}

        def reach(node: int, spent: int) -> None:
            if spent <= self.allowed[node] and spent < found.get(node, 99):
                found[node] = spent

        for node, spent in self.members[state]:
            reach(node, spent + 1)
            for edge, child in self.children[node].items():
                reach(child, spent + (edge != c))
        self.next[state][c] = to = self._state(found)
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, or None."""
        if not self.terms:
            return None
        if len(self.members) > 200_000:
            self.__init__(self.terms)  # bounds the memory of states met so far
        state, stem = self.start, None
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                return stem
            if (found := self.stems[state]) is not None:
                stem = found if stem is None else min(stem, found)
        return min((m for m in (self.match[state], stem) if m is not None), default=None)


def quoted(text: str, start: int, end: int, window: int) -> bool:
    """Whether a hit stands inside quotation marks or next to a word that reports speech."""
    left, right = text[max(0, start - window) : start], text[end : end + window]
    line = left.rpartition("\n")[2]
    for o, c in zip(OPEN_QUOTES, CLOSE_QUOTES, strict=True):
        inside = line.count(o) % 2 == 1 if o == c else line.rfind(o) > line.rfind(c)
        if inside and c in right.partition("\n")[0]:
            return True
    return bool(REPORTING.search(left[-24:].lower()))


class Matcher:
    """Evidence in texts; words seen before are remembered within a bound."""

    def __init__(self, model: Model, bound: int = 150_000) -> None:
        self.model, self.bound = model, bound
        self.automaton = Automaton(model.terms)
        self.known: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def words(self, text: str) -> dict[str, tuple[int, int]]:
        own = set(WORD.findall(text))
        if len(self.known) > self.bound:
            self.known = set()
        for w in own - self.known:
            if (m := self.automaton.find(w)) is not None:
                self.hits[w] = m
        self.known |= own
        return {w: self.hits[w] for w in own & self.hits.keys()} if not own.isdisjoint(self.hits) else {}

    def evidence(self, text: str) -> tuple[float, int, int]:
        """(weight of all hits in context, number of direct hits, number of quoted hits)."""
        p, low = self.model.params, text.lower()
        found = self.words(low)
        if not found:
            return 0.0, 0, 0
        total, direct, cited = 0.0, 0, 0
        for m in WORD.finditer(low):
            hit = found.get(m[0])
            if hit is None:
                continue
            weight = self.model.terms[hit[1]].weight * (p.fuzzy if hit[0] else 1.0)
            if quoted(low, m.start(), m.end(), p.window):
                cited += 1
                weight *= p.quoted
            else:
                direct += 1
            total += weight
        return total, direct, cited

    def score(self, total: float) -> float:
        z = self.model.bias + self.model.slope * math.log1p(total)
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(key.cast("string")) % 5 == 0


def near_copies(kinds: list[int], sketches: list[list[int]], least: float = 0.8, k: int = K) -> list[int]:
    """Numbers of the rows whose sketch resembles that of an earlier row of their kind that stays.

    Two such sketches share ``least`` of the longer one, so one of the rarest hashes of a sketch leads to each row it resembles.
    """
    gone: list[int] = []
    sets = [set(s) for s in sketches]
    places: dict[tuple[int, int], list[int]] = {}
    for row, (kind, own) in enumerate(zip(kinds, sets, strict=True)):
        lists = sorted((places.get((kind, h), []) for h in own), key=len)
        seen = {r for at in lists[: len(own) - math.ceil(least * len(own)) + 1] for r in at}
        for r in seen:
            both = own & sets[r]
            if len(both) >= least * max(len(own), len(sets[r])):
                union = sorted(own | sets[r])[:k]
                if len(both.intersection(union)) >= least * len(union):
                    gone.append(row)
                    break
        else:
            for h in own:
                places.setdefault((kind, h), []).append(row)
    return gone


def training_sample(docs: DataFrame, labels: DataFrame, p: Params, key: str, text: str) -> DataFrame:
    """(toxic, text) of a bounded sample of labelled documents: the first of each class by the hash of the id.

    A document with several labels is toxic if one says so. Copies would turn their rare words into terms, so of texts of one
    class that are equal but for case one is taken, before the bounds hold; of those taken, near copies go by their sketches.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(True)))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("_toxic"))
    texts = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    texts = texts.withColumn("_sha", F.sha2(F.lower("_text"), 256))
    order = F.struct(F.xxhash64("_key"), "_key")
    firsts = checkpoint(texts.select("_key", "_sha").join(known, "_key").groupBy("_toxic", "_sha").agg(F.min(order).alias("_order")))
    toxic = firsts.filter("_toxic = 1").orderBy("_order").limit(p.toxic_rows)
    picked = toxic.unionByName(firsts.filter("_toxic = 0").orderBy("_order").limit(p.clean_rows))
    picked = picked.select("_toxic", "_sha", F.col("_order._key").alias("_key"), "_order")
    sample = texts.join(F.broadcast(picked), ["_key", "_sha"]).groupBy("_toxic", "_sha")
    sample = checkpoint(sample.agg(F.min("_order").alias("_order"), F.min("_text").alias("_text")))
    found = sample.orderBy("_order", "_toxic").select("_toxic", "_sha", sketch(F.col("_text")).alias("_sketch")).toArrow()
    kinds, shas = found["_toxic"].to_pylist(), found["_sha"].to_pylist()
    gone = near_copies(kinds, found["_sketch"].to_pylist())
    if gone:
        copies = docs.sparkSession.createDataFrame([(int(kinds[k]), shas[k]) for k in gone], "_toxic long, _sha string")
        sample = sample.join(F.broadcast(copies), ["_toxic", "_sha"], "left_anti")
    return sample.select(F.col("_toxic").cast("int").alias("toxic"), "_text")


def _term_counts(sample: DataFrame, p: Params) -> DataFrame:
    """(term, toxic documents, clean documents) with the totals under the empty term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = {""}
                for w in set(WORD.findall(text.lower())):
                    if len(w) <= p.longest_term:
                        terms.add(w + "$")
                    terms.update(w[:k] for k in range(p.stem[0], min(len(w), p.stem[1] + 1)))
                counts[int(toxic == 1)].update(terms)
        terms = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(terms), 50_000):
            own = terms[i : i + 50_000]
            arrays = [pa.array(own), pa.array([counts[1][t] for t in own]), pa.array([counts[0][t] for t in own])]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "pos", "neg"])

    counted = sample.mapInArrow(work, "term string, pos long, neg long")
    return counted.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _choose(rows: list, p: Params) -> list[Term]:
    """Terms from candidates by falling evidence: a beginning gives way to a longer term that is as telling.

    Whole words that begin with a chosen beginning come after the others and beyond ``max_terms``: the beginning already matches
    them as they are, they are there for their misspellings.
    """
    counts = {r["term"]: (r["pos"], r["neg"]) for r in rows}
    chosen: list[tuple[str, float]] = []
    for r in rows:
        term, pos, neg = r["term"], r["pos"], r["neg"]
        share = (pos + 0.5) / (pos + neg + 1)
        if not term.endswith("$"):
            longer = [c for t, c in counts.items() if t != term and t.startswith(term)]
            if share < p.stem_precision or any(c[0] >= 0.95 * pos or (c[0] >= 0.8 * pos and c[1] < neg) for c in longer):
                continue
        chosen.append((term, share))
    stems = {t for t, _ in chosen if not t.endswith("$")}
    kept = [(t, w) for t, w in chosen if not any(t.startswith(s) and t != s for s in stems)][: p.max_terms]
    taken = tuple(t for t, _ in kept if not t.endswith("$"))
    kept += [(t, w) for t, w in chosen if t.endswith("$") and t.startswith(taken)]
    # Misspellings are looked for in whole words, the more the longer they are.
    edits = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    return [Term(t.rstrip("$"), not t.endswith("$"), round(w, 4), edits(t[:-1]) if t.endswith("$") else 0) for t, w in kept]


def learn(docs: DataFrame, labels: DataFrame, params: Params | None = None, key: str = "doc_id", text: str = "text") -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fifth.

    Terms are words and word beginnings that toxic documents use far more often. Only the counts of the best
    candidates and one number per sampled document come to the driver. Without labels of both classes the model
    is empty and every text scores as one without evidence.
    """
    p = params or Params()
    sample = training_sample(docs, labels, p, key, text).persist()
    counted = _term_counts(sample, p).persist()
    totals = counted.filter("term = ''").first()
    if totals is None or not totals["pos"] or not totals["neg"]:
        sample.unpersist()
        counted.unpersist()
        return Model(params=p)
    a, b = float(totals["pos"]), float(totals["neg"])
    k, n = F.col("pos"), F.col("pos") + F.col("neg")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    ratio = 2 * (part(k, a / (a + b)) + part(F.col("neg"), b / (a + b)))
    good = counted.filter((F.col("term") != "") & ((k + 0.5) / (n + 1) >= p.precision)).withColumn("g", ratio)
    rows = good.filter(F.col("g") >= p.evidence).orderBy(F.desc("g"), "term").limit(8 * p.max_terms).collect()
    terms = _choose(rows, p)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Model(tuple(terms), params=p))
        for batch in batches:
            for toxic, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if toxic != 1:
                    own = sorted({m[1] for m in matcher.words(t.lower()).values() if m[0]})
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(own)], names=["term"])

    clean_near = {r["term"]: r["count"] for r in sample.mapInArrow(near, "term long").groupBy("term").count().collect()}
    terms = [
        Term(t.text, t.stem, t.weight, 0 if clean_near.get(i, 0) > p.chance * b else t.edits) for i, t in enumerate(terms)
    ]
    model = Model(tuple(terms), params=p)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            totals = [matcher.evidence(t)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.float64())], names=["toxic", "total"])

    seen = sample.mapInArrow(weigh, "toxic int, total double").groupBy("toxic", "total").count().collect()
    sample.unpersist()
    counted.unpersist()
    y = np.array([float(r["toxic"] == 1) for r in seen])
    x = np.log1p(np.array([r["total"] for r in seen]))
    bias, slope = _logistic(x, y, np.array([float(r["count"]) for r in seen]))
    return Model(tuple(terms), bias, slope, p)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Weighted logistic regression with one feature; classes count alike."""
    weight = weight / np.where(y == 1, weight[y == 1].sum(), weight[y == 0].sum())
    beta = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        slope = design.T @ (weight * (mu - y)) + ridge * 0.01 * beta
        curve = (design * (weight * np.maximum(mu * (1 - mu), 1e-9))[:, None]).T @ design + ridge * 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
    return float(beta[0]), max(0.0, float(beta[1]))


def score_texts(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """One row per document: key (or the columns ``keep``), score, predicted, n_direct, n_quoted.

    ``score`` is between 0 and 1, ``predicted`` is 1 from 0.5 on. Texts are read whole; null and empty texts score as texts
    without evidence. Repeated rows, ties and null keys stay rows of their own; an empty table gives no rows;
    other columns are ignored. Labels, languages, sources and ids are no inputs.
    """
    added = {"score": pa.float64(), "predicted": pa.int32(), "n_direct": pa.int64(), "n_quoted": pa.int64()}
    state: dict[str, Matcher] = {}

    def work(texts: list[str]) -> dict[str, list]:
        matcher = state.setdefault("own", None) or Matcher(model)
        state["own"] = matcher
        out: dict[str, list] = {name: [] for name in added}
        for t in texts:
            total, direct, cited = matcher.evidence(t)
            value = matcher.score(total)
            for name, x in zip(added, (value, int(value >= 0.5), direct, cited), strict=True):
                out[name].append(x)
        return out

    return map_texts(docs, keep or [key], text, work, added)

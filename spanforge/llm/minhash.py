"""Near-duplicates by min-max hashing: banded candidates, links confirmed on full shingle sets, components."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import give_back, map_texts, smallest_reachable
from spanforge.session import checkpoint

# Fixed value: the finalizer of a 64-bit mixer.
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


@dataclass(frozen=True)
class Params:
    """24 bands of 4 values: two texts at a similarity of 0.8 share no band with probability 3e-6.

    Every hash evaluation gives two values, so the 96 values cost 48 evaluations a shingle.
    """

    words: int = 2
    percent: int = 80
    bands: int = 24
    rows: int = 4
    seed: int = 7_919
    star_rounds: int = 1
    block: int = 1_000  # nodes of a bucket that one task compares with as many others
    block_tokens: int = 2_000_000  # and their tokens


# Sets are compared by their tokens modulo this before they are confirmed.
SHORT = 2**31 - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX[0]
    x = (x ^ (x >> np.uint64(33))) * MIX[1]
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingle hashes of texts; hashes of words seen before come from a bounded cache."""

    def __init__(self, words: int, bound: int = 150_000) -> None:
        self.words, self.bound = words, bound
        self.cache: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self.cache) < self.bound:
            self.cache[w] = h
        return h

    def __call__(self, text: str) -> np.ndarray:
        """Sorted uint64 hashes. Only A-Z is lower-cased; words are split at ASCII white space."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        get, missing = self.cache.get, self._word
        hashes = np.array([get(w) or missing(w) for w in words], np.uint64)
        n = len(hashes)
        size = min(self.words, n)
        with np.errstate(over="ignore"):
            out = np.full(n - size + 1, size, np.uint64)
            for j in range(size):
                out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - size + 1 + j])
        return np.unique(out)


@lru_cache(maxsize=4)
def permutations(p: Params) -> tuple[np.ndarray, np.ndarray]:
    half = -(-p.bands * p.rows // 2)
    numbers = np.random.default_rng(p.seed).integers(0, 1 << 63, (2, half, 1), np.uint64)
    return numbers[0], numbers[1] * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, p: Params) -> np.ndarray:
    """One int64 for each band: the minima under all permutations, then the maxima, in runs of ``rows``."""
    key, odd = permutations(p)
    low = np.full(len(key), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(key), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 16_384):
            hashed = (shingles[at : at + 16_384] ^ key) * odd
            low = np.minimum(low, hashed.min(axis=1))
            high = np.maximum(high, hashed.max(axis=1))
        values = np.concatenate([low, high])[: p.bands * p.rows].reshape(p.bands, p.rows)
        out = np.arange(p.bands, dtype=np.uint64)
        for j in range(p.rows):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return out.view(np.int64)


def task_shingler(state: dict[str, Shingler], words: int) -> Shingler:
    """The shingler of a task; its cache ends with the task."""
    if "own" not in state:
        give_back()
        state["own"] = Shingler(words)
    return state["own"]


def set_id(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signatures(docs: DataFrame, p: Params, keep: list[str], text: str) -> DataFrame:
    """The columns ``keep``, n_shingles, node (the set's id; null if empty), bands."""
    added = {"n_shingles": pa.int64(), "node": pa.binary(), "bands": pa.list_(pa.int64())}

    state: dict[str, Shingler] = {}  # filled inside each task

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in added}
        shingles = task_shingler(state, p.words)
        for t in texts:
            s = shingles(t)
            out["n_shingles"].append(len(s))
            out["node"].append(set_id(s))
            out["bands"].append(band_hashes(s, p) if len(s) else [])
        return out

    return map_texts(docs, keep, text, work, added)


def _place(key: str, text: str) -> Column:
    """What a document is found by again: its key, or without one its text's hash."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def shingle_sets(docs: DataFrame, nodes: DataFrame, p: Params, key: str, text: str) -> DataFrame:
    """node, shingles of the wanted nodes, read again from the texts of their representatives."""
    added = {"_node": pa.binary(), "shingles": pa.list_(pa.int64())}

    state: dict[str, Shingler] = {}  # filled inside each task

    def work(texts: list[str]) -> dict[str, list]:
        sets = [task_shingler(state, p.words)(t) for t in texts]
        return {"_node": [set_id(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    wanted = docs.select(_place(key, text).alias("_at"), F.col(text).alias("_body")).join(nodes, "_at")
    made = map_texts(wanted, ["node"], "_body", work, added)
    # A key may come with several texts; only the one that made the node counts.
    return made.filter(F.col("node") == F.col("_node")).dropDuplicates(["node"]).select("node", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 * common >= percent * all."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.filter(common * (100 + percent) >= percent * (F.size("_x") + F.size("_y"))).select("a", "b")


def _members(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """bucket, node, comp of the buckets that hold nodes of several components."""
    if comps is None:
        own = buckets.withColumn("comp", F.col("node"))
        mixed = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
    else:
        own = buckets.join(comps.select("node", F.col("component").alias("_c")), "node", "left")
        own = own.select("bucket", "node", F.coalesce("_c", "node").alias("comp"))
        mixed = own.groupBy("bucket").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a <> _b").select("bucket")
    return own.join(mixed, "bucket", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(members: DataFrame, salt: int) -> DataFrame:
    """Every node with one node of each of its buckets, if the two aren't connected yet."""
    leader = members.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "comp")).alias("_l")
    )
    pairs = members.join(leader, "bucket").filter(F.col("comp") != F.col("_l.comp"))
    return _ordered(pairs.select(F.col("node").alias("a"), F.col("_l.node").alias("b")))


def _links_across(bucket: pa.Table, percent: int) -> tuple[list[bytes], list[bytes]]:
    """Pairs of a bucket's nodes in different components whose sets are alike, as many as join the components.

    Sets are compared through postings: a node's tokens point to the nodes that hold them too, and counting the
    hits gives its intersection with every other node at once.
    """
    nodes, blocks = bucket["node"].to_pylist(), bucket["block"].to_numpy()
    comps = np.unique(bucket["comp"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    cross = bucket["i"][0].as_py() != bucket["j"][0].as_py()
    if comps.max() == 0:
        return [], []
    tokens = bucket["tokens"].combine_chunks()
    sizes = np.diff(tokens.offsets.to_numpy())
    ids, flat = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    order = np.argsort(flat, kind="stable")
    posting, starts = owner[order], np.searchsorted(flat[order], np.arange(len(ids) + 1))
    first = np.cumsum(sizes) - sizes
    up = list(range(comps.max() + 1))

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    largest = np.bincount(comps).argmax()
    left: list[bytes] = []
    right: list[bytes] = []
    for x in np.flatnonzero(comps != largest):
        own = flat[first[x] : first[x] + sizes[x]]
        common = np.bincount(np.concatenate([posting[starts[t] : starts[t + 1]] for t in own]), minlength=len(nodes))
        alike = common * (100 + percent) >= percent * (sizes[x] + sizes)
        if cross:
            alike &= blocks != blocks[x]
        for y in np.flatnonzero(alike & (comps != comps[x])):
            a, b = root(int(comps[x])), root(int(comps[y]))
            if a != b:
                up[a] = b
                left.append(nodes[x])
                right.append(nodes[y])
    return left, right


def _across(members: DataFrame, sets: DataFrame, p: Params, exact: bool = False) -> DataFrame:
    """Links between different components of a bucket, found in tasks of two blocks of its nodes.

    Nodes outside the bucket's largest component are dealt to blocks that meet all blocks; those of the largest one meet only the
    others. A block holds at most about ``block`` nodes and ``block_tokens`` tokens. The sets travel as 31-bit numbers unless
    ``exact``, and no pair becomes a row unless it is alike; what is found is confirmed on the full sets like every other link.
    """
    token = (lambda x: x) if exact else (lambda x: F.pmod(x, F.lit(SHORT)).cast("int"))
    short = sets.select("node", F.transform("shingles", token).alias("tokens"))
    sized = members.join(sets.select("node", F.size("shingles").cast("long").alias("_size")), "node")
    of_comp = sized.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("_k"), F.sum("_size").alias("_s"))
    blocks = lambda k, s: F.greatest(F.ceil(k / p.block), F.ceil(s / p.block_tokens))
    total = of_comp.groupBy("bucket").agg(
        F.max(F.struct("_k", "comp", "_s")).alias("_big"), F.sum("_k").alias("_k"), F.sum("_s").alias("_s")
    )
    total = total.select(
        "bucket",
        F.col("_big.comp").alias("_largest"),
        F.greatest(blocks(F.col("_k") - F.col("_big._k"), F.col("_s") - F.col("_big._s")), F.lit(1)).cast("long").alias("_others"),
        blocks(F.col("_big._k"), F.col("_big._s")).cast("long").alias("_rest"),
    )
    placed = members.join(total, "bucket")
    large = F.col("comp") == F.col("_largest")
    dealt = F.xxhash64("node", "bucket")
    block = F.when(large, F.col("_others") + F.pmod(dealt, "_rest")).otherwise(F.pmod(dealt, "_others"))
    last = F.when(large, F.col("_others")).otherwise(F.col("_others") + F.col("_rest")) - 1
    placed = placed.withColumn("block", block).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    placed = placed.select("bucket", "node", "comp", "block", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"))

    def work(table: pa.Table) -> pa.Table:
        left, right = _links_across(table, p.percent)
        return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    found = placed.join(short, "node").groupBy("bucket", "i", "j").applyInArrow(work, "a binary, b binary")
    return _ordered(found)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", params: Params | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: key, the columns ``keep``, n_shingles, component_id, kept.

    Documents with the same shingle set are one node. Nodes that share a band are candidates; only pairs that aren't connected yet are
    compared: first each node with one node of its bucket, which joins most of a group of copies with as many comparisons as it has
    members, then, inside tasks, the nodes that still lie in different components. Every link is confirmed on the full sets; if one is not, the
    last step is done again on whole tokens, so no candidate that could join two components is left out. ``component_id`` is the smallest key reachable over links.

    Null and empty texts, and texts of white space, have an empty set and are linked with nothing. Texts with fewer words than a shingle have
    their whole sequence as one. Repeated rows are documents of their own with the same component. A null key is never the component of others unless
    all keys of the component are null; ``kept`` is true for the rows whose key is the component's. An empty
    table gives no rows; other columns are ignored.
    """
    p = params or Params()
    at = F.when(F.col(key).isNull(), _place(key, text)).alias("_at")
    signed = checkpoint(signatures(docs.select(key, *keep, text, at), p, [key, *keep, "_at"], text))
    at = F.coalesce(F.min(key).cast("string"), F.min("_at")).alias("_at")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(key).alias(key), at, F.first("bands").alias("bands"))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = checkpoint(_members(buckets, None).select("bucket", "node"))
    wanted = nodes.select("node", "_at").join(buckets.select("node").distinct(), "node")
    sets = checkpoint(shingle_sets(docs, wanted, p, key, text))
    links = comps = None
    members = buckets.withColumn("comp", F.col("node"))
    for turn in range(p.star_rounds + 2):
        star, exact = turn < p.star_rounds, turn > p.star_rounds
        pairs = checkpoint(_star(members, turn) if star else _across(members, sets, p, exact))
        candidates = pairs.count()
        if candidates:
            found = checkpoint(verified(pairs, sets, p.percent))
            links = found if links is None else links.unionByName(found)
            comps = smallest_reachable(links, "a", "b")
        # A candidate that was not confirmed may have hidden others of the same two components: they are compared by whole tokens.
        if not star and (exact or not candidates or found.count() == candidates):
            break
        if candidates:
            members = checkpoint(_members(buckets, comps))
    smallest = nodes.select("node", F.col(key).alias("_rep"))
    if comps is not None:
        grouped = smallest.join(comps, "node")
        lowest = grouped.groupBy("component").agg(F.min("_rep").alias("_low"))
        linked = comps.join(lowest, "component").select("node", "_low")
        smallest = smallest.join(linked, "node", "left").select("node", F.coalesce("_low", "_rep").alias("_rep"))
    full = signed.filter(F.col("node").isNotNull()).join(smallest, "node")
    full = full.select(key, *keep, "n_shingles", F.col("_rep").alias("component_id"))
    empty = signed.filter(F.col("node").isNull()).select(key, *keep, "n_shingles", F.col(key).alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))

"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 majority bits over the XXH64 of word shingles.  To find
all pairs within ``tau`` differing bits, the bits are grouped into partitions,
correlated bits together, and each partition gets its own threshold ``t_i`` with
``sum(t_i + 1) > tau``: a pair within ``tau`` is then within ``t_i`` in some
partition.  The thresholds (-1: not probed) come from dynamic programming over
estimated probe and candidate counts, and so does the number of partitions, so
the plan follows the number of distinct fingerprints.  Each fingerprint probes
the ball of ``t_i`` around its partition key; probes are verified by the number
of differing bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from culprit.llm.common import discard, freeing, materialize
from culprit.llm.components import connected_components

_BITS = 64
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 16


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the shingles of a whole text in order, repeats included; a shorter text is one shingle, none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    stops = stops[width - 1 :] or stops[-1:]
    return np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, which are read in blocks; 0 without any."""
    bits = np.zeros(_BITS, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = hashes[k : k + _BLOCK].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """Majority bits over the shingles of a whole text."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: fingerprints as signed 64-bit numbers; null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or "", width, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(freeing(run), "doc_id long, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, share of ones by bit, and correlation of bits over all fingerprints."""

    def run(batches):
        total = np.zeros((_BITS + 1, _BITS + 1), np.int64)
        for b in batches:
            x = np.unpackbits(np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            x = np.hstack([x, np.ones((len(x), 1), np.float32)])
            total += (x.T @ x).astype(np.int64)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    sums = np.zeros((_BITS + 1) ** 2)
    for k, v in distinct.select("fp").mapInArrow(freeing(run), "k long, v long").groupBy("k").agg(F.sum("v")).collect():
        sums[k] = v
    sums = sums.reshape(_BITS + 1, _BITS + 1)
    n = int(sums[-1, -1])
    p = sums[-1, :_BITS] / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return n, p, (sums[:_BITS, :_BITS] / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)


@dataclass(frozen=True)
class Part:
    """Bits of one partition and the distance up to which it is probed."""

    bits: tuple[int, ...]
    radius: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def ball(self) -> list[int]:
        return [sum(1 << b for b in c) for r in range(self.radius + 1) for c in combinations(self.bits, r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Greedy groups of about equal size, the most correlated bits together."""
    c, free, groups = np.abs(correlation), set(range(_BITS)), []
    for k in range(m):
        size = _BITS // m + (k < _BITS % m)
        seed = max(free, key=lambda b: sum(c[b, x] for x in free if x != b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            b = max(free, key=lambda x: sum(c[x, g] for g in group))
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, bits: list[int]) -> list[float]:
    """Probability that two random fingerprints differ in at most t of ``bits``, by t."""
    d = np.array([1.0])
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        d = np.convolve(d, [1 - q, q])
    return np.cumsum(d).tolist()


def plan(n: int, p: np.ndarray, correlation: np.ndarray, tau: int = 3, probe_cost: float = 4.0) -> list[Part]:
    """The cheapest partitions and thresholds for ``n`` distinct fingerprints."""
    best: tuple[float, list[Part]] | None = None
    for m in range(1, 2 * tau + 2):
        groups = group_bits(correlation, m)
        cost = []
        for g in groups:
            near = within(p, g)
            row, balls = [0.0], 0
            for t in range(min(tau, len(g)) + 1):
                balls += comb(len(g), t)
                row.append(probe_cost * n * (balls + 1) + n * (n - 1) / 2 * near[t])
            cost.append(row)
        need = tau + 1  # sum of (t + 1) over the partitions
        table: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
        for row in cost:
            now: dict[int, tuple[float, list[int]]] = {}
            for have, (c, path) in table[-1].items():
                for t1, extra in enumerate(row):
                    k = min(need, have + t1)
                    if k not in now or c + extra < now[k][0]:
                        now[k] = (c + extra, [*path, t1 - 1])
            table.append(now)
        if need in table[-1]:
            c, radii = table[-1][need]
            if best is None or c < best[0]:
                best = c, [Part(tuple(g), r) for g, r in zip(groups, radii, strict=True) if r >= 0]
    return best[1]


def similar_links(distinct: DataFrame, parts: list[Part], tau: int, name: str = "simhash") -> DataFrame:
    """Pairs ``a, b`` within ``tau`` bits that connect all distinct fingerprints (``fp``) which such pairs connect.

    Every probe of a key is first compared with the least fingerprint of that
    key.  Probes and fingerprints of a key are compared with each other only if
    they are then still in different groups, so a large group of near copies
    gives a link for each of its members and not one for each of its pairs.
    """

    def keyed(rows: DataFrame, balls: list[list[int]]) -> DataFrame:
        cells = [F.struct(F.lit(k).alias("part"), F.lit(signed(p.mask)).alias("mask"), F.lit(signed(d)).alias("flip")) for k, (p, ball) in enumerate(zip(parts, balls, strict=True)) for d in ball]
        cell = rows.select("*", F.explode(F.array(*cells)).alias("e"))
        return cell.select(*rows.columns, "e.part", F.col("fp").bitwiseAND(F.col("e.mask")).bitwiseXOR(F.col("e.flip")).alias("key"))

    index, probe = [[0]] * len(parts), [p.ball() for p in parts]
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau
    heads = keyed(distinct, index).groupBy("part", "key").agg(F.min("fp").alias("head"))
    star = keyed(distinct, probe).join(heads, ["part", "key"]).where((F.col("fp") != F.col("head")) & close("fp", "head"))
    star = materialize(star.select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct(), f"{name}-star")
    groups = connected_components(star)
    named = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("group"))
    named = materialize(named, f"{name}-named")
    x, y = keyed(named, index).toDF("a", "group_a", "part", "key"), keyed(named, probe).toDF("b", "group_b", "part", "key")
    rest = x.join(y, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.col("group_a") != F.col("group_b")) & close("a", "b"))
    rest = materialize(rest.select("a", "b").distinct(), f"{name}-rest")
    discard(named)
    return star.union(rest)


def near_duplicates(docs: DataFrame, *, width: int = 3, tau: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Equal fingerprints form a class first, so copies of any number are one
    node; links are sought between classes.  Null and empty texts have
    fingerprint zero and are linked like others; rows with a null id take part,
    and a component's id is its least id that is not null.  A very long text's
    bits are counted in blocks; other columns, whatever their names, are ignored;
    an empty table gives an empty result.  Returns ``doc_id, fp, fingerprint,
    component_id``.
    """
    rows = materialize(fingerprints(docs, width=width, seed=seed, id_col=id_col, text_col=text_col), "simhash-fp")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-class")
    n, p, correlation = bit_statistics(classes)
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    if n < 2:
        return rows.join(classes, "fp").select("doc_id", "fp", text, F.col("least").alias("component_id"))
    links = similar_links(classes.select("fp"), plan(n, p, correlation, tau), tau)
    parts = connected_components(links)
    discard(links)
    rooted = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", text, "component_id")

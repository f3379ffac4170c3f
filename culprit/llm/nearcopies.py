"""Groups of near copies: documents whose sets of word shingles have a Jaccard similarity of at least ``least``.

SimHash comes first: classes whose 64 majority bits differ in ``tau`` or fewer are
linked if their shingles are similar enough.  No such bound on bits holds for all
pairs of that similarity (at 0.8, about ten bits differ), so groups that are still
apart are then compared by prefix filtering, which misses none: with all
shingles in one global order, two sets of similarity ``t`` or more share a
shingle among the first ``n - ceil(t n) + 1`` of each.  Any order will do.  Here
shingles whose hash is in the first ``LOW`` of its range come first, by the
number of classes that have them, then the others by hash.  So a set's prefix is
mostly shingles that no other set has, which need no comparing, and passages
that many documents share come after them.

Documents with equal sets form a class first.  A shared shingle first links its
classes to one of them, in some rounds to another one each.  Of the classes that
then share a shingle with another group all shingles are counted, which leaves
those that hold little of their own.  These are in one global order, so two sets
whose first common shingle is the i-th of ``m`` and the j-th of ``n`` share at
most ``1 + min(m - i, n - j)``: what a class has alone comes first and counts
against each of its pairs.  A shingle first links its classes to the one that has
it earliest, which is the nearest to what a family of copies has in common.
Classes outside that one's group are then compared with the others, as far as
places allow the similarity.  So neither a large group of near copies nor copies
edited away from it are compared pair by pair; copies that are all alike just
below the bound, none of them nearer to the rest, still are.  Every link is
verified on the whole sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from culprit.llm.common import discard, freeing, materialize, sieved
from culprit.llm.components import connected_components
from culprit.llm.simhash import bit_statistics, majority, plan, shingle_hashes, similar_links
from culprit.llm.tokens import slices

#: Share of the hash range whose shingles are counted: the prefix is a fifth of a set at a similarity of 0.8.
LOW = 0.25
#: Rounds in which a shingle's classes are compared with one of them.
ROUNDS = 2


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles of a text; a shorter text is one shingle, a text without words none."""
    return np.unique(shingle_hashes(text, width))


def code_of(found: np.ndarray) -> int:
    """One signed number for a set of shingles."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(found.tobytes(), 1)
    return x - (1 << 64) if x >= 1 << 63 else x


def need(n: int, share: Fraction) -> int:
    """How many of a set's first shingles the filter looks at."""
    return n + int(share * -n // 1) + 1 if n else 0


def first_of(found: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set: the shingles in the low range, and those after it that the prefix takes if they are too few."""
    low = int(np.searchsorted(found, np.uint64(int(LOW * (1 << 64)))))
    return found[:low], found[low : max(low, need(len(found), share))]


#: Classes of hash values in which a sketch counts a set's shingles.
CELLS = 256


def sketch(found: np.ndarray) -> bytes:
    """Shingles of a set by the first bits of their hash; two sets share at most the sum of the lesser counts."""
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes()


def may_be_linked(pairs: DataFrame, classes: DataFrame, share: Fraction) -> DataFrame:
    """Those of the pairs ``a, b`` of codes whose sketches allow the similarity: most others are told apart by half a kilobyte."""

    def run(batches):
        p, q = share.numerator, share.numerator + share.denominator
        for b in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, CELLS) for k in (2, 3))
            m, n = (np.asarray(b.column(k)) for k in (4, 5))
            met = np.minimum(x, y)
            most = np.where((met == 65535).any(axis=1), np.minimum(m, n), met.sum(axis=1, dtype=np.int64))  # a full cell tells nothing
            keep = pa.array(q * most >= p * (m + n))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    own = classes.select("code", "sketch", "size")
    both = pairs.join(own.toDF("a", "x", "m"), "a").join(own.toDF("b", "y", "n"), "b")
    return both.select("a", "b", "x", "y", "m", "n").mapInArrow(freeing(run), "a long, b long")


def linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, share: Fraction, name: str) -> DataFrame:
    """Those of the pairs ``a, b`` of codes whose sets have the similarity."""

    def sets(batches):
        for b in (b.slice(at, len(part)) for b in batches for at, part in slices(b.column(1))):
            found = [shingles(t or "", width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["code", "h"])

    def verify(batches):
        p, q = share.numerator, share.numerator + share.denominator
        for b in batches:
            x, y = b.column(2), b.column(3)
            good = []
            for k in range(b.num_rows):
                m, n = (np.asarray(c[k].values).view(np.uint64) for c in (x, y))
                good.append(q * len(np.intersect1d(m, n, assume_unique=True)) >= p * (len(m) + len(n)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    pairs = materialize(may_be_linked(pairs, classes, share), f"{name}-pairs")
    codes = materialize(pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct().join(classes.select("code", "t1", "t2"), "code"), f"{name}-codes")
    found = materialize(texts_of(codes, texts).mapInArrow(freeing(sets), "code long, h array<long>"), f"{name}-sets")
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = materialize(both.mapInArrow(freeing(verify), "a long, b long"), f"{name}-links")
    discard(pairs, codes, found)
    return links


def texts_of(codes: DataFrame, texts: DataFrame) -> DataFrame:
    """``code, text``: a text of each of ``codes(code, t1, t2)``; the other texts stay where they are."""
    met = sieved(texts, codes, "t1", "t2").where("_met").drop("_met")
    return met.join(codes, ["t1", "t2"]).groupBy("code").agg(F.min("text").alias("text"))


def fingerprint_pairs(classes: DataFrame, tau: int) -> DataFrame:
    """Pairs ``a, b`` of codes that connect the classes whose fingerprints are within ``tau`` bits."""
    heads = materialize(classes.groupBy("fp").agg(F.min("code").alias("head")), "copies-heads")
    same = classes.join(heads, "fp").where("code <> head").select(F.col("head").alias("a"), F.col("code").alias("b"))
    n, p, correlation = bit_statistics(heads)
    if n < 2:
        return same
    links = similar_links(heads.select("fp"), plan(n, p, correlation, tau), tau, "copies-simhash")
    named = links.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    return same.union(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2, text``: rows that agree in the first three are equal, so tables of rows need no texts."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), text.alias("text"))


def groups_of(docs: DataFrame, *, width: int, least: float, tau: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, t1, t2, code, component_id, component_code`` of every row of :func:`marked`."""
    share = Fraction(least).limit_denominator(1000)
    texts = marked(docs, id_col, text_col)

    def run(batches):
        for b in (b.slice(at, len(part)) for b in batches for at, part in slices(b.column(3))):
            every = [shingle_hashes(t or "", width) for t in b.column(3).to_pylist()]
            bits = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            found = [np.unique(h) for h in every]
            del every
            parts = [first_of(x, share) for x in found]
            made = [pa.array([code_of(x) for x in found], pa.int64()), pa.array(bits), pa.array(list(map(len, found)), pa.int64()), pa.array(list(map(sketch, found)), pa.binary()), *(pa.array([p[k].view(np.int64) for p in parts], pa.list_(pa.int64())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["doc_id", "t1", "t2", "code", "fp", "size", "sketch", "low", "rest"])

    every = materialize(texts.mapInArrow(freeing(run), "doc_id long, t1 long, t2 int, code long, fp long, size long, sketch binary, low array<long>, rest array<long>"), "copies-all")
    grouped = every.groupBy("code").agg(F.min("doc_id").alias("least"), F.min(F.struct("t1", "t2")).alias("t"), *(F.first(c).alias(c) for c in ("fp", "size", "sketch", "low", "rest")))
    classes = materialize(grouped.select("code", "least", "t.*", "fp", "size", "sketch", "low", "rest"), "copies-classes")
    rows = materialize(every.select("doc_id", "t1", "t2", "code"), "copies-rows")
    discard(every)

    near_bits = linked(fingerprint_pairs(classes, tau), classes, texts, width, share, "copies-bits")
    groups = connected_components(near_bits)
    p, q = share.numerator, share.denominator
    posted = materialize(posts(classes, share), "copies-posted")
    alike = f"`group` <> group_a and {q} * least(size, size_a) >= {p} * greatest(size, size_a)"

    def facts(groups: DataFrame) -> DataFrame:
        return classes.select("code", "size").join(groups, F.col("code") == F.col("node"), "left").select("code", "size", F.coalesce("component", "code").alias("group"))

    links, done = near_bits, [near_bits]
    for k in range(ROUNDS):
        known = materialize(facts(groups), "copies-known")
        heads = posted.groupBy("key").agg(F.min_by("code", F.xxhash64("code", F.lit(k))).alias("a"))
        pairs = posted.join(heads, "key").where("code <> a").select("a", F.col("code").alias("b")).distinct()
        pairs = pairs.join(known.toDF("b", "size", "group"), "b").join(known.toDF("a", "size_a", "group_a"), "a").where(alike).select("a", "b")
        more = linked(pairs, classes, texts, width, share, "copies-star")
        discard(known)
        if more.isEmpty():
            discard(more)
            break
        done.append(more)
        links = links.union(more)
        groups = connected_components(links)

    open_ = still_open(posted, facts(groups)).select("code").distinct().join(classes.select("code", "t1", "t2"), "code")
    open_ = materialize(open_, "copies-open")
    # among those that are left, all shingles are counted: what only one of them has needs no comparing
    full = materialize(whole_sets(open_, texts, width), "copies-full")
    again = materialize(posts(full, share), "copies-again")
    mixed = materialize(headed(still_open(again, facts(groups))), "copies-mixed")
    first = mixed.where("`group` <> group_a").where(in_reach(share, "place", "size", "place_a", "size_a"))
    first = first.select(F.least("code", "code_a").alias("a"), F.greatest("code", "code_a").alias("b")).distinct()
    more = linked(first, classes, texts, width, share, "copies-first")
    done.append(more)
    if not more.isEmpty():
        links = links.union(more)
        groups = connected_components(links)
        discard(mixed)
        mixed = materialize(headed(still_open(again, facts(groups))), "copies-mixed")
    # of two classes in different groups at least one is not in the group of the head
    x, y = mixed.where("`group` <> group_a").alias("x"), mixed.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.group") != F.col("y.group")) & ((F.col("y.group") == F.col("y.group_a")) | (F.col("x.code") < F.col("y.code")))
    rest = x.join(y, apart & in_reach(share, "x.place", "x.size", "y.place", "y.size"))
    rest = rest.select(F.least("x.code", "y.code").alias("a"), F.greatest("x.code", "y.code").alias("b")).distinct()
    more = linked(rest, classes, texts, width, share, "copies-rest")
    if not more.isEmpty():
        groups = connected_components(links.union(more))

    rooted = classes.select("code", "least").join(groups, F.col("code") == F.col("node"), "left").select("code", "least", F.coalesce("component", "code").alias("root"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "code")).alias("best"))
    found = rooted.join(best, "root").select("code", F.col("best.least").alias("component_id"), F.col("best.code").alias("component_code"))
    result = materialize(rows.join(found, "code").select("doc_id", "t1", "t2", "code", "component_id", "component_code"), "copies-groups")
    discard(posted, open_, full, again, mixed, classes, rows, more, *done)
    return result


def posts(classes: DataFrame, share: Fraction) -> DataFrame:
    """``key, code, place``: the shingles of each class's prefix that another class's prefix may have too, and their places in its set from 1.

    A shingle of the low range is looked up only if another class has it, so a
    class with enough shingles of its own posts none.
    """
    key, own = Window.partitionBy("key"), Window.partitionBy("code")
    low = classes.select("code", F.explode("low").alias("key")).withColumn("df", F.count("*").over(key)).where("df > 1")
    low = materialize(low, "copies-shared")
    p, q = share.numerator, share.denominator
    prefix = F.col("size") - F.ceil(F.col("size") * p / q) + 1
    alone = classes.select("code", "size", F.size("low").alias("n_low")).join(low.groupBy("code").agg(F.count("*").alias("n")), "code")
    wanted = alone.select("code", (F.col("n_low") - F.col("n")).alias("alone"), prefix.alias("prefix")).where("alone < prefix")
    place = (F.col("alone") + F.row_number().over(own.orderBy("df", "key"))).cast("int")
    chosen = low.join(wanted, "code").withColumn("place", place).where("place <= prefix").select("key", "code", "place")
    after = classes.select("code", F.size("low").alias("n_low"), F.posexplode("rest").alias("nth", "key"))
    both = chosen.union(after.select("key", "code", F.col("n_low") + F.col("nth") + 1))
    found = both.withColumn("least", F.min("code").over(key)).withColumn("most", F.max("code").over(key)).where("least <> most")
    return found.select("key", "code", "place")


def still_open(posted: DataFrame, known: DataFrame) -> DataFrame:
    """``key, code, place, size, group`` of shingles that classes of different groups have."""
    key = Window.partitionBy("key")
    named = posted.join(known, "code")
    mixed = named.withColumn("low", F.min("group").over(key)).withColumn("high", F.max("group").over(key)).where("low <> high")
    return mixed.select("key", "code", "place", "size", "group")


def headed(mixed: DataFrame) -> DataFrame:
    """Rows of :func:`still_open` with ``code_a, place_a, size_a, group_a`` of their key's head: the class that has it earliest in its set."""
    row = F.struct(*(F.col(c).alias(f"{c}_a") for c in ("code", "place", "size", "group")))
    heads = mixed.groupBy("key").agg(F.min_by(row, F.struct(F.col("place") / F.col("size"), "code")).alias("head"))
    return mixed.join(heads, "key").select(*mixed.columns, "head.*")


def in_reach(share: Fraction, i: str, m: str, j: str, n: str) -> Column:
    """Whether sets of ``m`` and ``n`` shingles may have the similarity if the i-th of one and the j-th of the other is the first that they share."""
    p, q = share.numerator, share.numerator + share.denominator
    return q * (1 + F.least(F.col(m) - F.col(i), F.col(n) - F.col(j))) >= p * (F.col(m) + F.col(n))


def whole_sets(codes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Rows as :func:`posts` takes them, with all shingles in the counted part, of ``codes(code, t1, t2)``."""

    def sets(batches):
        for b in (b.slice(at, len(part)) for b in batches for at, part in slices(b.column(1))):
            found = [shingles(t or "", width).view(np.int64) for t in b.column(1).to_pylist()]
            made = [pa.array(list(map(len, found)), pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array([[]] * len(found), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["code", "size", "low", "rest"])

    return texts_of(codes, texts).mapInArrow(freeing(sets), "code long, size long, low array<long>, rest array<long>")


def near_copies(docs: DataFrame, *, width: int = 5, least: float = 0.8, tau: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group of every row: connected by pairs of similarity ``least`` or more.

    Null texts count as empty; texts without words form one group.  A group's id
    is its least id that is not null, and is null where all are; its code is that
    of a class that has this id.  Repeated rows are in one group.  A very long
    text takes memory in proportion to it; other columns, whatever their names,
    are ignored; an empty table gives an empty result.  Returns ``doc_id, code,
    component_id, component_code``.
    """
    return groups_of(docs, width=width, least=least, tau=tau, id_col=id_col, text_col=text_col).drop("t1", "t2")


def one_of_each(docs: DataFrame, *, width: int = 5, least: float = 0.8, tau: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are left if one of each group of near copies stays: one of its least id.

    Cases are as in :func:`near_copies`; all columns are kept.
    """
    groups = groups_of(docs, width=width, least=least, tau=tau, id_col=id_col, text_col=text_col)
    chosen = groups.where("code = component_code and doc_id <=> component_id").groupBy("code").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("k"))
    chosen = materialize(chosen.select(*key_of("k.doc_id"), F.col("k.t1").alias("t1"), F.col("k.t2").alias("t2")), "copies-chosen")
    # rows that stay and are no repeats need not be moved: only the others, and what the sieve takes for them, meet the chosen ones
    every = groups.groupBy(*key_of("doc_id"), "t1", "t2").agg(F.count("*").alias("n"))
    doubtful = every.join(chosen.withColumn("stays", F.lit(True)), _KEY, "left").where("n > 1 or stays is null").select(_KEY)
    doubtful = materialize(doubtful, "copies-doubtful")
    text = docs[text_col].cast("string")
    rows = docs.select(F.struct(docs.columns).alias("row"), *key_of(docs[id_col].cast("long")), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"))
    rows = sieved(rows, doubtful, *_KEY)
    met = rows.where("_met").join(chosen, _KEY, "left_semi").groupBy(_KEY).agg(F.first("row").alias("row"))
    return rows.where("not _met").select("row.*").union(met.select("row.*"))


#: What tells rows apart, without nulls, so that a join and the aggregate after it are dealt out once.
_KEY = ["null_id", "id", "t1", "t2"]


def key_of(doc_id: Column | str) -> tuple[Column, Column]:
    """The first two of ``_KEY``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return c.isNull().alias("null_id"), F.coalesce(c, F.lit(0).cast("long")).alias("id")

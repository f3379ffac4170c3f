"""Near copies by shingles against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from culprit.llm import nearcopies as N
from culprit.llm.common import sieved

RNG = random.Random(11)


def words(n: int) -> list[str]:
    return ["".join(RNG.choices("abcdefghijkl", k=RNG.randint(2, 8))) for _ in range(n)]


def edited_copies() -> list:
    out = [None, "", "  ", "one", "One", "one two three four", "one two three four five", "one two  three four\nfive"]
    line = words(40)
    for _ in range(30):
        base = words(RNG.choice([6, 20, 60, 150, 400])) + (line if RNG.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for _ in range(RNG.randint(1, max(1, len(w) // 40))):
                w[RNG.randrange(len(w))] = words(1)[0]
            out.append(" ".join(w))
    w = words(100)
    for k in range(12):  # a chain: only neighbours are similar
        out.append(" ".join(w))
        w = w[6:] + words(6)
    return out + out[20:24]


def brute_force(texts: list) -> list[int]:
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, up = [cut(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in range(len(sets)):
        for a in range(b):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(texts))]


def test_groups_are_those_of_brute_force(spark, monkeypatch):
    texts = edited_copies()
    want = brute_force(texts)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in N.near_copies(docs).collect()}
    assert got == dict(enumerate(want)) and 30 < len(set(want)) < len(texts) - 40
    for low, rounds in ((0.0, 0), (0.7, 1)):  # the order and the rounds change no result
        monkeypatch.setattr(N, "LOW", low)
        monkeypatch.setattr(N, "ROUNDS", rounds)
        assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == got
    assert N.near_copies(docs.limit(0)).count() == 0


def test_prefixes_of_similar_sets_meet():
    share, df = N.Fraction(0.8).limit_denominator(1000), {x: RNG.randint(2, 9) for x in range(400)}
    hashed = {x: RNG.randrange(1 << 64) for x in range(400)}
    for _ in range(300):
        a = set(RNG.sample(range(400), RNG.randint(1, 80)))
        b = set(sorted(a)[RNG.randint(0, 2) :]) | set(RNG.sample(range(400), RNG.randint(0, 8)))
        if b and 10 * len(a & b) >= 8 * len(a | b):
            firsts = []
            for s in (a, b):
                low, rest = N.first_of(np.array(sorted(hashed[x] for x in s), np.uint64), share)
                back = {h: x for x, h in hashed.items()}
                order = sorted(low.tolist(), key=lambda h: (df[back[h]], h)) + rest.tolist()
                firsts.append(set(order[: N.need(len(s), share)]))
                assert len(order) >= N.need(len(s), share)
            assert firsts[0] & firsts[1]


def test_stage_removes_copies_of_similarity_08(spark, sf):
    texts = edited_copies()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.near_duplicate_groups(spark, docs, sf).select("doc_id").collect()}
    assert kept == set(brute_force(texts))


def test_stage_tells_rows_of_one_id_apart(spark, sf):
    base, other, third = (" ".join(words(60)) for _ in range(3))
    rows = [(1, base), (2, base + " tail"), (2, other), (None, third), (None, third + " tail"), (None, base + " end"), (5, base.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in P.near_duplicate_groups(spark, docs, sf).collect()]
    assert len(kept) == 3 and {(1, base), (2, other)} < set(kept)
    assert [t for i, t in kept if i is None][0] in (third, third + " tail")


def test_a_family_edited_away_from_its_base_is_not_compared_pair_by_pair(spark, monkeypatch):
    base, texts = words(150), []
    for k in range(240):
        w = list(base)
        for at in RNG.sample(range(150), k % 7):  # up to three edits the base is near, beyond that alike below the bound
            w[at] = words(1)[0] + str(k)
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    compared, linked = {}, N.linked

    def counting(pairs, *rest):
        compared[rest[-1]] = compared.get(rest[-1], 0) + pairs.count()
        return linked(pairs, *rest)

    monkeypatch.setattr(N, "linked", counting)
    want = brute_force(texts)
    for rounds in (2, 0):
        monkeypatch.setattr(N, "ROUNDS", rounds)
        compared.clear()
        assert {r.doc_id: r.component_id for r in N.near_copies(docs).collect()} == dict(enumerate(want))
        assert compared["copies-rest"] < len(texts), compared
    assert 20 < len(set(want)) < 140


def test_a_sieve_keeps_every_partner_and_few_others(spark):
    table = spark.range(20_000).selectExpr("id", "cast(id % 7 as int) as part", "case when id % 3 = 0 then null else id end as maybe")
    keys = table.where("id % 100 = 5").select("id", "part")
    kept = sieved(table, keys, "id", "part")
    assert kept.columns == ["id", "part", "maybe", "_met"] and kept.count() == 20_000
    met = {r.id for r in kept.where("_met").select("id").collect()}
    assert {r.id for r in keys.collect()} <= met and len(met) < 200 + 20_000 / 10
    assert sieved(table, keys.where("false"), "id", "part").where("_met").isEmpty()


def test_rows_that_stay_are_not_moved(spark):
    """Texts go through a shuffle only where a row may be dropped or repeats another."""
    rows = [(k, f"own words of text number {k} are {k * 7} and {k * 11} here") for k in range(3000)]
    docs = spark.createDataFrame([*rows, rows[5], (4001, rows[6][1])], "doc_id long, text string")
    left = N.one_of_each(docs)
    assert sorted(r.doc_id for r in left.collect()) == list(range(3000))
    assert "Union" in left._jdf.queryExecution().optimizedPlan().toString()

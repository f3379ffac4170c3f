"""The pipeline's stages on the smallest tables, and on odd rows."""

import random

import pytest

import corpus_pipeline as P

RNG = random.Random(3)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int) -> str:
    return " ".join("".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 8))) for _ in range(n))


def test_stages_keep_their_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs.count()
        docs = P.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
    assert docs.where("n_chars <> char_length(text)").count() == 0
    pieces = P.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = P.quality(spark, docs, sf)
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.98 * good.count()


@pytest.fixture(scope="module")
def odd(spark):
    long, passage = words(3000), words(40)
    texts = [None, "", "  ", "a", words(60), long, long, words(30) + " " + passage, words(20) + " " + passage, "日本語" * 200, "\n\n"]
    rows = [(k, t, None if k % 3 == 0 else "en", None, len(t or "")) for k, t in enumerate(texts)] + [(5, long, "en", "s", 1), (None, words(50), "en", "s", 1), (4, words(50), "en", "s", 1)]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA + ", code string, k0 int").repartition(3)


def test_stages_take_odd_rows_and_empty_tables(spark, sf, odd, tmp_path):
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, odd, sf)
        assert out.columns == P.COLUMNS, name
        assert 0 < out.count() <= odd.count(), name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert P.quality(spark, odd, str(tmp_path)).count() == odd.count()  # nothing is rejected without a label
    assert P.quality(spark, odd.limit(0), sf).count() == 0
    assert P.packing(spark, odd.limit(0), sf).count() == 0
    pieces = P.packing(spark, odd, sf).collect()
    assert sum(p.length for p in pieces) >= odd.count()


def test_leaks_go_however_long_the_document_is(spark, tmp_path):
    item = words(25)
    spark.createDataFrame([(1, item), (2, "three short words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, words(2000) + " " + " ".join(item.split()[3:20]) + " " + words(500)), (2, words(400) + " three short words " + words(400)), (3, "three short words here"), (4, words(300)), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in P.benchmark_leaks(spark, docs, str(tmp_path)).collect()) == [2, 4, 5]


def brute_force(docs: list[tuple[int, str]], items: list[str]) -> dict[int, str]:
    """Near-dedup, repeated substrings and leaks by their definitions."""

    def sets(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    shingles, group = [sets(t) for _, t in docs], list(range(len(docs)))
    for b in range(len(docs)):
        for a in range(b):
            if 10 * len(shingles[a] & shingles[b]) >= 8 * len(shingles[a] | shingles[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    kept, seen = {}, set()
    for i, t in (d for k, d in enumerate(docs) if group[k] == k):
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone |= set(range(k, k + 100))
            seen.add(raw[k : k + 100])
        kept[i] = bytes(c for k, c in enumerate(raw) if k not in gone).decode()
    windows = {tuple(x.split()[k : k + 13]) for x in items for k in range(len(x.split()) - 12)}
    return {i: t for i, t in kept.items() if not any(tuple(t.split()[k : k + 13]) in windows for k in range(len(t.split()) - 12))}


def test_stages_equal_brute_force(spark, tmp_path):
    passage, item, texts = words(60), words(30), []
    for k in range(25):
        w = words(120).split()
        texts.append(" ".join(w) + (" " + passage + " " + words(20) if k % 4 == 0 else "") + (" " + item + " " + words(20) if k % 7 == 3 else ""))
        w[RNG.randrange(120)] = "changed"
        texts += [" ".join(w)] if k % 5 == 0 else []
    docs = list(enumerate(texts))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    for _, stage in P.STAGES[1:4]:
        out = P.materialize(stage(spark, out, str(tmp_path)), "test")
    assert {r.doc_id: r.text for r in out.collect()} == brute_force(docs, [item])

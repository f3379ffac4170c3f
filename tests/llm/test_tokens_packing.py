"""Token counts and packing against the library itself."""

import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from culprit.llm.packing import CapacityTree, best_fit_decreasing, pack
from culprit.llm.tokens import chunks_of, count_tokens, whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n\nb", "a \n b", "x\ny", "it's we'll 's", "Héllo wörld ñ 日本語 テキスト", "<|endoftext|> in <|endoftext|>",
    "tab\tnew\r\nline\x0b\x1c.", "nbsp here   wide", "a" * 5000, "12345 678 9", "!!! ??? ...", "emoji 👩‍👩‍👧 end", "a\t b", "a\t  b", "a \tb", "a \n\n b\n c", "\n\na\n", "a\x1c b \x1fc", " \xa0x \u3000 y", "null\x00byte here", "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(3, "  ", "x", 1), (None, "no id at all", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, sequence_id int")


@pytest.fixture(scope="module")
def tok():
    return tokenizers.Tokenizer.from_file(PATH)


def test_counts_equal_the_library(docs, tok):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH).collect())
    want = [(str(i), t or "") for i, t in enumerate(TEXTS)] + [("3", "  "), ("None", "no id at all")]
    want = sorted((i, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in want)
    assert got == want


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(docs, name):
    assert count_tokens(docs, public_tokenizers.path(name)).count() == len(TEXTS) + 2


def test_chunks_are_whole_pretokens(tok):
    for t in TEXTS:
        if t and "<|" not in t:
            first, rest = chunks_of(t)
            ids = tok.encode(first, add_special_tokens=False).ids
            for k in rest:
                ids += tok.encode(k if k[:1] == "\n" else " " + k, add_special_tokens=False).ids
            assert ids == tok.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_whole_tokens_are_proven(tok):
    proven = whole_tokens(tok)
    assert len(proven) > 30_000
    assert all(tok.encode(s, add_special_tokens=False).ids == [i] for s, i in list(proven.items())[::997])


def test_packing_is_a_partition_of_all_ids(docs, tok):
    ids = {}
    for i, t in [*enumerate(TEXTS), (None, "no id at all")]:
        ids[i] = tok.encode(t or "", add_special_tokens=False).ids + [0]
    rows = pack(docs, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    for i, found in by_doc.items():
        spans = sorted((r.start, r.length) for r in found)
        if i == 3:  # repeats: both rows are packed
            assert sum(n for _, n in spans) == 2 * len(ids[i])
            continue
        at = 0
        for start, length in spans:
            assert start == at
            at += length
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_best_fit_takes_the_tightest():
    tree = CapacityTree(16)
    for s, c in enumerate([3, 7, 12]):
        tree.add(c, s)
    assert tree.take(4) == (7, 1) and tree.take(4) == (12, 2) and tree.take(4) is None
    sequence, offset, n = best_fit_decreasing(np.array([9, 7, 8, 8, 16]), 16, 0)
    assert n == 3 and sorted(offset.tolist()) == [0, 0, 0, 8, 9]


def test_empty_table(docs):
    assert count_tokens(docs.limit(0), PATH).count() == 0 and pack(docs.limit(0), PATH).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(2)
    for window, n in ((16, 40), (1024, 300), (100, 0)):
        lengths = rng.integers(1, window, n)
        sequence, offset, end = best_fit_decreasing(lengths, window, 0)
        room: list[int] = []
        for need in sorted(lengths.tolist(), reverse=True):
            fits = [c for c in room if c >= need]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else window) - need)
        used = np.bincount(sequence, weights=lengths, minlength=end) if n else np.zeros(0)
        assert sorted((window - used).astype(int).tolist()) == sorted(room)
        for s in range(end):
            at = np.sort(offset[sequence == s])
            assert at[0] == 0 and (np.diff(np.append(at, used[s])) > 0).all()


def test_little_padding_on_real_documents(spark, sf):
    sizes = pack(spark.read.parquet(f"{sf}/documents.parquet").coalesce(1), PATH).groupBy("sequence_id").sum("length").collect()
    padding = sum(0 if r[1] & (r[1] - 1) == 0 else 1024 - r[1] for r in sizes)
    assert padding <= 0.01 * sum(r[1] for r in sizes)


def test_tables_of_chunks_are_bounded(tok):
    import pyarrow as pa

    from culprit.llm.packing import ChunkIds
    from culprit.llm.tokens import KEY_CHARS, ChunkCounter, slices

    texts = pa.array(["x" + str(k) * 3 + " y" + "ab" * 40 + f"{k} long and short words {k}" for k in range(300)] + [None, "a b " * 50_000])
    for cap in (0, 10, 10_000):
        counter, ids = ChunkCounter(PATH, cap), ChunkIds(PATH, cap)
        got = np.concatenate([counter.count_all(t) for _, t in slices(texts, 2000)])
        assert got.tolist() == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()]
        assert [v.tolist() for _, t in slices(texts, 2000) for v in ids.ids(t)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        assert len(counter) <= cap and len(ids) <= cap and all(len(k) <= KEY_CHARS for k in counter)

"""WARC round trip and embedding links against brute force."""

import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from culprit.llm import warc as W
from culprit.llm.embed import near_duplicates
from culprit.llm.hnsw import Hnsw
from culprit.llm.warc import archive_and_deduplicate, records_in


def test_warc_round_trip(spark):
    odd = "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n"
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "u\r\nX: y", odd), (5, "é", "é\n日本\r\n"), (6, "n", None), (7, "n", ""), (8, "z", "x" * 300_000)]
    rows += [(None, "q", "only null"), (9, "q", "tie"), (9, "q", "tie")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(map(tuple, archive_and_deduplicate(pages).drop("url").collect()), key=str)
    by = {}
    for i, _, h in rows:
        by.setdefault((h or "").encode(), []).append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max((x for x in by[raw] if x is not None), default=None)
        again = top is not None and i != top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)
    assert archive_and_deduplicate(pages.limit(0)).count() == 0
    joined = archive_and_deduplicate(pages.withColumn("file", F.lit(1)).withColumn("digest", F.lit(2)), shipped_bytes=0)  # lists that are too large to ship
    assert sorted(map(tuple, joined.drop("url").collect()), key=str) == got
    few = archive_and_deduplicate(pages, least_bytes=4).where("payload_bytes < 4 and record_type = 'revisit'")
    assert few.count() == 0


def test_archives_hold_valid_records(spark, tmp_path):
    html = ["same", "same", "", None, "é" * 50, "x" * 50]
    pages = spark.createDataFrame([(k, f"http://h/{k}", h) for k, h in enumerate(html)] + [(0, "http://h/0", "same")], "page_id long, url string, html string").repartition(2)
    W.write_archive(pages, f"{tmp_path}/all")
    heads = W.read_headers(spark, f"{tmp_path}/all").collect()
    assert len({h.record_id for h in heads}) == len(heads) == 7 and all(h.record_type == "response" for h in heads)
    assert sorted(r.html for r in W.read_records(spark, f"{tmp_path}/all").collect()) == sorted([h or "" for h in html] + ["same"])
    W.deduplicate(spark, f"{tmp_path}/all", f"{tmp_path}/fresh")
    fresh = {h.page_id: h for h in W.read_headers(spark, f"{tmp_path}/fresh").collect()}
    assert fresh[0].refers_to == 1 and fresh[2].refers_to == 3 and fresh[4].refers_to is None
    found = {}
    for f in tmp_path.glob("fresh/part-*"):
        raw, at = f.read_bytes(), 0
        while at < len(raw):  # a gzip member a record
            d = zlib.decompressobj(31)
            (h, block), = records_in(io.BytesIO(d.decompress(raw[at:])))
            at = len(raw) - len(d.unused_data)
            found[h["warc-record-id"]] = h, block
    assert len(found) == 7
    for h, block in found.values():
        if h["warc-type"] == "revisit":
            to, _ = found[h["warc-refers-to"]]
            assert not block and to["warc-type"] == "response" and to["warc-target-uri"] == h["warc-refers-to-target-uri"] and to["x-page-id"] == h["x-refers-to-page-id"]


def test_long_records_end_with_a_zero_byte():
    for n in (0, 10, (1 << 24) - 1, 1 << 24, (1 << 25) + 5):
        raw = bytes(n)
        made = W.compressed(raw)
        assert made[-1] == 0 and gzip.decompress(made) == raw


def test_records_need_a_version_line():
    with pytest.raises(ValueError):
        list(records_in(io.BytesIO(b"HTTP/1.1 200\r\n\r\n")))
    with pytest.raises(ValueError):
        list(records_in(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")))


def test_hnsw_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:800] = x[699] + rng.normal(scale=0.05, size=(100, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = Hnsw(x).search(x, 48)
    true = np.argsort(-(x @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.9


def test_links(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    for k in range(40):
        x[100 + k] = x[k % 7] + rng.normal(scale=0.08, size=16)
    x[200:260] = x[3] + rng.normal(scale=0.05, size=(60, 16))
    x[300:330] = x[5]
    x = x.astype(np.float32).astype(float)
    rows = [(int(k), [float(v) for v in r], 0, "c") for k, r in enumerate(x)]
    odd = [(900, None, 0, "c"), (901, [0.0] * 16, 0, "c"), (902, [float("nan")] * 16, 0, "c"), (903, [None] * 16, 0, "c"), (904, [], 0, "c"), (905, [float("inf")] + [1.0] * 15, 0, "c")]
    odd += [(906, [1.0, 2.0], 0, "c"), (907, [2.0, 4.1], 0, "c"), (None, [1.0] * 16, 0, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, key string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for _ in range(10):
        root = [min([root[k], *(root[j] for j in np.flatnonzero(link[k]))]) for k in range(len(x))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, shard=100).collect()}
    assert len(got) == len(rows) + len(odd)
    assert {k: got[k] for k in range(400)} == {k: (int(link[k].sum()), root[k], root[k] == k) for k in range(400)}
    assert all(got[k] == (0, k, True) for k in range(900, 906))
    assert got[906] == (1, 906, True) and got[907] == (1, 906, False)
    assert near_duplicates(df.limit(0)).count() == 0


def test_counts_are_symmetric_and_ids_may_repeat(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 12))
    x[40:160] = x[0] + rng.normal(scale=0.12, size=(120, 12))  # near the bound: searches may find a link from one end only
    x[170:200] = x[1]
    ids = [int(k) for k in range(300)]
    ids[250], ids[251] = 5, 5  # one id, three vectors
    rows = [(i, [float(v) for v in r], "n", 1) for i, r in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string, no int")
    got = near_duplicates(df, shard=60, ef=4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = sorted((i, int(n)) for i, n in zip(ids, link.sum(axis=1), strict=True))
    assert sorted((r.vec_id, r.n_links) for r in got.collect()) == want
    one = {r.vec_id for r in got.where("component_id = 0").collect()}
    assert {*range(40, 160)} <= one

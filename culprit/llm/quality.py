"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Every text becomes a short vector of document statistics.  Random Fourier
features approximate a Gaussian kernel over the standardised statistics; the
normal equations of a ridge regression on them are sums over rows, so each
partition sends one matrix and the driver solves a system whose size is the
number of features.  Isotonic regression on held-back training rows turns the
raw score into a probability.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from culprit.llm.common import discard, freeing, materialize

#: Labelled rows that training reads at most, those with the least hash of their id.
TRAIN_ROWS = 20_000
#: Partitions of the training rows, each of which sends one matrix to the driver.
TRAIN_PARTS = 8
#: Bins of raw scores from which the calibration is fitted.
BINS = 512

_SENTENCE_END = re.compile(r"[.!?…]['\")\]]*$")

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "newline", "punctuation", "symbols", "stops", "bars", "bangs",
    "non_ascii", "distinct_words", "distinct_trigrams", "top_word", "top_trigram", "distinct_lines", "line_words", "ended_lines",
    "symbol_ended_words", "upper_words", "long_words", "short_words",
]

_SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{}~/", np.uint8)
_PUNCT = np.frombuffer(b".,;:!?\"'()[]-", np.uint8)


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; an empty text gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words = len(raw), text.split()
    w = max(1, len(words))
    upper = int(h[65:91].sum())
    letters = max(1, upper + int(h[97:123].sum()))
    distinct = set(words)
    tri = list(zip(words, words[1:], words[2:], strict=False))
    n_tri = max(1, len(tri))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    top = max(counts.values(), default=0)
    tris: dict[tuple, int] = {}
    for x in tri:
        tris[x] = tris.get(x, 0) + 1
    lengths = list(map(len, words))
    return [
        math.log1p(n),
        math.log1p(len(words)),
        sum(lengths) / w,
        upper / letters,
        float(h[48:58].sum()) / n,
        float(h[32]) / n,
        float(h[10]) * 10 / n,
        float(h[_PUNCT].sum()) / n,
        float(h[_SYMBOLS].sum()) / n,
        float(h[46]) / w,
        float(h[124]) / w,
        float(h[33]) / w,
        float(h[128:].sum()) / n,
        len(distinct) / w ** 0.8,
        len(tris) / n_tri,
        top / w,
        max(tris.values(), default=0) / n_tri,
        len(set(lines)) / n_lines,
        math.log1p(w / n_lines),
        sum(1 for x in lines if _SENTENCE_END.search(x.rstrip())) / n_lines,
        sum(1 for x in distinct if x[-1] in "#$%&*|!~^=+<>@" and not x.isalnum()) / max(1, len(distinct)),
        sum(1 for x in distinct if len(x) > 1 and x.isupper()) / max(1, len(distinct)),
        sum(1 for x in lengths if x > 20) / w,
        sum(1 for x in lengths if x < 3) / w,
    ]


@dataclass
class Model:
    """Fitted classifier; a few hundred kilobytes whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cos = np.cos(z @ self.directions + self.phase) * math.sqrt(2 / len(self.phase))
        return np.hstack([cos, z / 10, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0, 1)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the weighted non-decreasing fit of ``y``."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / max(w1 + w2, 1e-12), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and an array ``x`` of statistics."""
    picked = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = T.StructType([*(picked.schema[k] for k in keep), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return picked.mapInArrow(freeing(run), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = TRAIN_ROWS,
    n_features: int = 256,
    gamma: float = 0.05,
    ridge: float = 1e-3,
    seed: int = 7,
) -> Model | None:
    """Fit on a bounded sample of labelled rows; None if it has no labelled row.

    Three quarters of the sample (by a hash of the id) fit the ridge weights,
    the rest the calibration.  Repeated labels of an id count as their mean.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    y = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    sample = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)))
    found = materialize(with_statistics(rows, ["doc_id", "y", "fold"], "text").repartition(TRAIN_PARTS), "quality-train")
    d = len(STATISTICS)
    moments = found.select(F.count("*").alias("n"), *(f(F.col("x")[k]).alias(f"{s}{k}") for k in range(d) for s, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["n"]:
        discard(found)
        return None
    rng = np.random.default_rng(seed)
    model = Model(
        np.array([moments[f"m{k}"] for k in range(d)]),
        np.maximum(np.array([moments[f"s{k}"] for k in range(d)]), 1e-6),
        rng.normal(0, math.sqrt(2 * gamma), (d, n_features)),
        rng.uniform(0, 2 * math.pi, n_features),
        np.zeros(n_features + d + 1),
        np.array([-1e9, 1e9]),
        np.array([1.0, 1.0]),
    )
    size = n_features + d + 1

    def sums(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            z, t = model.features(_matrix(b.column(0))), np.asarray(b.column(1))
            total += np.hstack([z.T @ z, (z.T @ t)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def normal(part: DataFrame) -> np.ndarray:
        return sum(np.frombuffer(r[0]).reshape(size, size + 1) for r in part.select("x", "y").mapInArrow(freeing(sums), "part binary").collect())

    def solve(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :size] + ridge * np.eye(size) * max(1.0, total[size - 1, size - 1]) / size, total[:, size])

    fit = normal(found.where("fold <> 0"))
    held = normal(found.where("fold = 0"))
    if not fit[size - 1, size - 1] or not held[size - 1, size - 1]:
        fit = held = fit + held
        calibrate = found
    else:
        calibrate = found.where("fold = 0")
    model.weights = solve(fit)

    def binned(batches):
        total = np.zeros((BINS, 2))
        for b in batches:
            k = np.clip(((model.raw(_matrix(b.column(0))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            np.add.at(total, k, np.stack([np.ones(len(k)), np.asarray(b.column(1))], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    bins = sum(np.frombuffer(r[0]).reshape(BINS, 2) for r in calibrate.select("x", "y").mapInArrow(freeing(binned), "part binary").collect())
    some = np.flatnonzero(bins[:, 0])
    model.levels = isotonic(bins[some, 1] / bins[some, 0], bins[some, 0])
    model.edges = (some + 0.5) / BINS * 2 - 0.5
    discard(found)
    return model


def classify(
    docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Score every whole text: ``doc_id, score, predicted`` and ``keep``.

    Null texts score as empty ones.  Without a model (no labelled row) every
    score is 1.  Repeated and null ids are carried, equal texts score alike, a
    very long text takes memory in proportion to it, an empty table gives an
    empty result, and columns of any name may stand beside; nothing is shuffled.
    """
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("__text"), *(docs[k].alias(k) for k in keep))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *(docs.schema[k] for k in keep)])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(STATISTICS))
            s = m.score(x) if m is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), *batch.columns[2:]], names=["doc_id", "score", "predicted", *keep]
            )

    return picked.mapInArrow(freeing(run), schema)

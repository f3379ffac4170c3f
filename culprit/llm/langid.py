"""Language identification: script ranges, word scores, Viterbi spans.

A model of character 2- and 3-grams inside words gives every word a score per
language.  The script of a word narrows the candidates to the languages that
training saw in that script.  Viterbi over the words, with a penalty for each
switch, labels spans of mixed-language text; the document gets the language
whose spans hold most letters, and that share of the letters as its score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from culprit.llm.common import freeing
from culprit.llm.tokens import slices

#: Documents of each language that training reads, about: those whose hash is below a bound.
TRAIN_DOCS = 2_000
#: N-grams of the model for each language, the most frequent first.
MODEL_GRAMS = 60_000
#: Words whose scores a worker remembers, and characters of such a word.
WORD_TABLE, WORD_CHARS = 300_000, 32
#: Characters that are scored at once, and entries of a lookup table that is addressed directly.
BLOCK, DENSE = 1 << 20, 1 << 24

#: What is neither a letter, a mark on one, nor white space.
_NO_LETTER = r"[^\p{L}\p{M}\p{Z}\s\x0b\x1c-\x1f\x{85}]+"
#: First code points of script ranges and the script from there on.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([r[0] for r in _RANGES])
SCRIPTS = sorted({r[1] for r in _RANGES})
_SCRIPT_AT = np.array([SCRIPTS.index(r[1]) for r in _RANGES])
_OPEN, _SHUT = "\x02", "\x03"


def words_of(texts: pa.Array) -> pa.ListArray:
    """Words of texts: letters and their marks between white space, in lower case; what has no letter is none."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.replace_substring_regex(texts, _NO_LETTER, "")))
    words = lists.values
    keep = pc.match_substring_regex(words, r"\p{L}")
    if pc.all(keep).as_py() in (True, None):
        return lists
    inside = np.concatenate([[0], np.cumsum(np.asarray(keep.cast(pa.int8())), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(inside[np.asarray(lists.offsets)], pa.int32()), words.filter(keep))


def scripts_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of most characters of each word of ``codes``, by its place in ``SCRIPTS``."""
    found = _SCRIPT_AT[np.searchsorted(_STARTS, codes, side="right") - 1]
    word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    return np.bincount(word * len(SCRIPTS) + found, minlength=len(starts) * len(SCRIPTS)).reshape(-1, len(SCRIPTS)).argmax(axis=1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams_of(word: str) -> list[str]:
    w = f"{_OPEN}{word}{_SHUT}"
    return [w[k : k + 2] for k in range(len(w) - 1)] + [w[k : k + 3] for k in range(len(w) - 2)]


class Lookup:
    """Places of keys below ``limit``; 0 for a key that isn't there."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, limit: int):
        o = np.argsort(keys)
        self.keys, self.places, self.dense = keys[o], places[o].astype(np.int32), None
        if limit <= DENSE:
            self.dense = np.zeros(limit, np.int32)
            self.dense[self.keys] = self.places

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[keys]
        if not len(self.keys):
            return np.zeros(len(keys), np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at], 0)


class Model:
    """Log probabilities of n-grams by language, and scripts by language."""

    def __init__(self, counts: list[tuple[str, str, int]], switch: float = 6.0, floor: float = 8.0):
        grams = [(lang, g, n) for lang, g, n in counts if not g.startswith("script:")]
        self.langs = sorted({c[0] for c in counts})
        self.switch, self.floor = switch, floor
        col = {x: k for k, x in enumerate(self.langs)}
        row: dict[str, int] = {}
        for _, g, _ in grams:
            row.setdefault(g, len(row) + 1)
        table = np.zeros((len(row) + 1, max(1, len(self.langs))))
        for lang, g, n in grams:
            table[row[g], col[lang]] += n
        total = table.sum(axis=0)
        table = np.log((table + 0.5) / (total + 0.5 * len(table)))
        self.table = np.vstack([table, np.zeros(table.shape[1])]).astype(np.float32)  # the last row is for no n-gram at all
        # characters by number, pairs by number, and rows of pairs and of triples by those
        chars = sorted({c for g in row for c in g})
        self.alphabet = np.array([ord(c) for c in chars], np.int64)
        number = {c: k + 1 for k, c in enumerate(chars)}
        size = len(chars) + 1
        pairs = sorted({g[:2] for g in row})
        place = {g: k + 1 for k, g in enumerate(pairs)}
        self.pair = Lookup(np.array([number[g[0]] * size + number[g[1]] for g in pairs], np.int64), np.arange(1, len(pairs) + 1), size * size)
        self.pair_row = np.array([0, *(row.get(g, 0) for g in pairs)], np.int32)
        triples = [g for g in row if len(g) == 3]
        self.triple = Lookup(np.array([place[g[:2]] * size + number[g[2]] for g in triples], np.int64), np.array([row[g] for g in triples], np.int64), (len(pairs) + 1) * size)
        share = {(lang, g[7:]): n for lang, g, n in counts if g.startswith("script:")}
        letters = Counter()
        for (lang, _), n in share.items():
            letters[lang] += n
        seen = {g for _, g in share}
        # languages that a word's script rules out; a script that training never saw rules out none
        self.out = np.array([[s in seen and share.get((x, s), 0) < 0.01 * letters[x] for x in self.langs] for s in SCRIPTS]).reshape(len(SCRIPTS), -1)
        self.out[self.out.all(axis=1)] = False

    def sums(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probabilities of words that are given with their marks of begin and end."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        ids = np.where(self.alphabet[at] == codes, at + 1, 0)
        size, none = len(self.alphabet) + 1, len(self.table) - 1
        last = np.append(starts[1:], len(codes)) - 1
        pair = self.pair(ids * size + np.append(ids[1:], 0))
        rows = self.pair_row[pair]
        rows[last] = none
        third = self.triple(pair * np.int64(size) + np.append(ids[2:], (0, 0)))
        third[last] = third[last - 1] = none
        return np.add.reduceat(self.table[rows] + self.table[third], starts, axis=0)

    def score(self, words: list[str]) -> np.ndarray:
        """A row per word: log scores relative to the best candidate, at least ``-floor``."""
        out, at = np.zeros((len(words), len(self.langs)), np.float32), 0
        while at < len(words):
            stop, size = at, 0
            while stop < len(words) and (size := size + len(words[stop]) + 2) <= BLOCK:
                stop += 1
            part = words[at : max(stop, at + 1)]
            if len(part) == 1 and size > BLOCK:  # a word of any length is summed in pieces that share two characters
                w = f"{_OPEN}{part[0]}{_SHUT}"
                s, where = np.zeros((1, len(self.langs)), np.float32), np.zeros(len(SCRIPTS), np.int64)
                for k in range(0, len(w) - 2, BLOCK):
                    piece = code_points(w[k : k + BLOCK + 2])
                    s += self.sums(piece, np.zeros(1, np.int64)) - (self.sums(piece[-2:], np.zeros(1, np.int64)) if k + BLOCK + 2 < len(w) else 0)
                    where[scripts_of(piece, np.zeros(1, np.int64))[0]] += len(piece)
                script = where.argmax(keepdims=True)
            else:
                length = np.fromiter(map(len, part), np.int64, len(part))
                plain = np.cumsum(length) - length
                script = scripts_of(code_points("".join(part)), plain)
                s = self.sums(code_points("".join([f"{_OPEN}{w}{_SHUT}" for w in part])), plain + 2 * np.arange(len(part)))
            s[self.out[script]] = -np.inf
            s -= s.max(axis=1, keepdims=True)
            out[at : at + len(part)] = np.maximum(s, -self.floor)
            at += len(part)
        return out


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, max_grams: int = MODEL_GRAMS
) -> Model:
    """Count n-grams of a bounded sample of labelled whole texts of every language.

    Of each language about ``max_docs`` rows are read, those whose hash of id and
    text is below the bound that its number of rows gives; equal rows count
    once.  Counting is distributed, and ``max_grams`` n-grams a language reach
    the driver.
    """
    labelled = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null and text <> ''")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, max_docs / n))) for x, n in sorted(sizes.items())))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 12) / float(1 << 52)
    sample = labelled.where(place < share).select("text", "lang").distinct()
    out = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang in pc.unique(batch.column(1)).to_pylist():
                for _, texts in slices(batch.column(0).filter(pc.equal(batch.column(1), lang))):
                    seen = pc.value_counts(words_of(texts).values)
                    found.setdefault(lang, Counter()).update(dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)))
        for lang, words in found.items():
            grams: Counter = Counter()
            for w, n in words.items():
                grams["script:" + SCRIPTS[scripts_of(code_points(w), np.zeros(1, np.int64))[0]]] += n * len(w)
                for g in grams_of(w):
                    grams[g] += n
            names = list(grams)
            for k in range(0, len(names), 20_000):
                part = names[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array([grams[g] for g in part])], schema=out)

    counts = sample.mapInArrow(freeing(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.col("gram").startswith("script:").desc(), F.desc("n"), "gram")
    top = counts.withColumn("k", F.row_number().over(most)).where(F.col("k") <= max_grams).orderBy("lang", "k")
    return Model([(r[0], r[1], r[2]) for r in top.collect()])


class Labeller:
    """Viterbi over batches of documents in lockstep."""

    def __init__(self, model: Model, cap: int = WORD_TABLE):
        self.model, self.cap = model, cap
        self.word: dict[str, int] = {}
        self.scores = np.zeros((cap, len(model.langs)), np.float32)

    def scores_of(self, words: list[str]) -> np.ndarray:
        """A row of scores per word; those of short words are remembered while there is room."""
        at = np.array([self.word.get(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(at < 0)
        out = self.scores[np.maximum(at, 0)]
        if len(fresh):
            new = [words[k] for k in fresh.tolist()]
            out[fresh] = made = self.model.score(new)
            short = [k for k, w in enumerate(new) if len(w) <= WORD_CHARS]
            if len(self.word) + len(short) > self.cap:
                self.word.clear()
                short = short[: self.cap]
            base = len(self.word)
            self.scores[base : base + len(short)] = made[short]
            self.word.update((new[k], base + i) for i, k in enumerate(short))
        return out

    def label(self, texts: pa.Array, spans: bool = False):
        """Per text: language (or ``und``), score, and spans if asked for."""
        langs = self.model.langs
        if not langs:
            return [("und", 0.0, [])] * len(texts)
        lists = words_of(texts)
        ends = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        scores, letters = self.scores_of(words), np.fromiter(map(len, words), np.int64, len(words))
        every = np.asarray(coded.indices).astype(np.int64)
        ids = [every[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        n = np.array([len(x) for x in ids])
        order = np.argsort(-n, kind="stable")
        flat = np.concatenate([ids[k] for k in order]) if len(order) else np.zeros(0, np.int64)
        at = np.concatenate([[0], np.cumsum(n[order])])[:-1]
        steps = int(n.max()) if len(n) else 0
        active = np.searchsorted(-n[order], -np.arange(steps), side="left")  # documents longer than t
        state = np.zeros(len(flat), np.int8 if len(langs) < 128 else np.int16)
        stay, jump, best = [], [], None
        final = np.zeros((len(order), len(langs)), np.float32)
        for t in range(steps):
            k = active[t]
            s = scores[flat[at[:k] + t]]
            if t:
                if k < len(best):
                    final[k : len(best)] = best[k:]
                    best = best[:k]
                top = best.argmax(axis=1)
                other = best[np.arange(k), top] - self.model.switch
                keep = best >= other[:, None]
                stay.append(keep)
                jump.append(top.astype(state.dtype))
                best = s + np.where(keep, best, other[:, None])
            else:
                best = s
        if steps:
            final[: len(best)] = best
        last = final.argmax(axis=1).astype(state.dtype)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            now = last[:k]
            state[at[:k] + t] = now
            if t:
                keep = stay[t - 1][np.arange(k), now]
                last[:k] = np.where(keep, now, jump[t - 1])
        weight = letters[flat] if len(flat) else np.zeros(0, np.int32)
        share = np.zeros((len(order), len(langs)))
        np.add.at(share, (np.repeat(np.arange(len(order)), n[order]), state), weight)
        out: list = [None] * len(texts)
        for r, k in enumerate(order):
            if not n[k]:
                out[k] = ("und", 0.0, [])
                continue
            win = int(share[r].argmax())
            found = []
            if spans:
                own = state[at[r] : at[r] + n[k]]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n[k])]
                found = [{"first": a, "last": b - 1, "lang": langs[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
            out[k] = (langs[win], float(share[r, win] / share[r].sum()), found)
        return out


def identify(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Language of every whole text, in one pass without a shuffle.

    Null texts and texts without a letter (number signs are none) are ``und``
    with score 0; without any training row every text is ``und``.  Null ids and
    repeated rows are carried, equally good languages go to the first by name.
    A text of any length is labelled whole; its task holds its words.  An empty
    table gives an empty result, and columns of any name may stand beside.
    Returns ``doc_id, lang_pred, score``, then ``spans`` (first and last word,
    language) if asked for, then the columns in ``keep``.
    """
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shipped.value)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                rows = batch.slice(at, len(texts))
                found = labeller.label(texts, spans)
                cols = [rows.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                cols += [pa.array([f[2] for f in found], span)] if spans else []
                names = ["doc_id", "lang_pred", "score", *(["spans"] if spans else []), *keep]
                yield pa.RecordBatch.from_arrays([*cols, *(rows.column(2 + k) for k in range(len(keep)))], names=names)

    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<first:long,last:long,lang:string>>" if spans else "")
    schema += "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("__text"), *(docs[k].alias(k) for k in keep))
    return picked.mapInArrow(freeing(run), schema)

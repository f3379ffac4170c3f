"""Token counts by a whole-token shortcut.

A byte-level BPE tokenizer first splits text into pre-tokens and then merges
bytes inside each pre-token.  Offline, :func:`whole_tokens` proves which
vocabulary strings encode alone as exactly one token (the string is its own
pre-token and its merges end in its id).  A pre-token of that set counts one;
only the rest are merged.

Pre-tokens are found per *chunk*.  The last white-space character of a run,
before a character that is none, always begins a pre-token of the byte-level
pattern: a space leads the next pre-token, any other stands alone.  So a text is
cut at such spaces and line feeds and the sum over its chunks is exact.  Arrow
cuts some megabytes of texts at once and numbers their distinct chunks, so
Python looks at each distinct chunk only, and results of short ones are
remembered in a bounded table.  Texts with special strings, or tokenizers of
another kind, go through the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from culprit.llm.common import arrow_map

#: Entries of a worker's chunk table and characters of a key; beyond them, chunks are encoded each time.
CHUNK_TABLE, KEY_CHARS = 400_000, 32
#: Bytes of text that are split at once, about.
SLICE_BYTES = 8 << 20

_CUT = re.compile(r" (?=\S)")
_BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    """The tokenizer of a ``.json`` file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def is_plain_byte_level(path: str) -> bool:
    """Whether the chunk rule holds: byte-level pattern, no normalizer, no prefix space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    )


def whole_tokens(tok) -> dict[str, int]:
    """Vocabulary strings that encode alone as one token, with their ids.

    Proven with the library itself: each decoded string is encoded, and kept
    if the result is its own id and nothing else.
    """
    ids = sorted(tok.get_vocab(with_added_tokens=False).values())
    strings = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    proven = {}
    for i, s, e in zip(ids, strings, tok.encode_batch(strings, add_special_tokens=False), strict=True):
        if s and e.ids == [i] and "�" not in s:
            proven[s] = i
    return proven


def is_cut(key: str) -> bool:
    """Whether a key is cut off at a boundary: a character that is no white space follows the cut one."""
    c = key[1:2] if key[:1] == "\n" else key[:1]
    return c != "" and not c.isspace()


def at_spaces(text: str) -> list[str]:
    return text.replace("\n", " \n").split(" ")


def chunks_of(text: str) -> tuple[str, list[str]]:
    """``text`` as its first chunk and the keys of the others.

    A key that begins with a line feed stands for itself, any other for itself
    with a space before it.
    """
    first, *rest = at_spaces(text)
    if not all(map(is_cut, rest)):
        first, *rest = _CUT.split(text)
    return first, rest


class ChunkTable(dict):
    """What :meth:`encoded` makes of chunks, by key and filled as texts need it.

    Both the number of keys and their lengths are bounded, so the table is
    bounded in bytes; what isn't remembered is encoded again.
    """

    def __init__(self, path: str, cap: int = CHUNK_TABLE):
        super().__init__()
        self.tok, self.cap = load_tokenizer(path), cap
        self.plain = is_plain_byte_level(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        names = self.tok.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(names.values()) + 1, bool)  # ids that begin with a space or a line feed
        self.leads[[i for s, i in names.items() if s[:1] in "ĠĊ"]] = True

    def merged(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of a thousand chunks each, and where each chunk's ids begin and the last one's end.

        A space or line feed stands at the start of a chunk and nowhere else, so
        the ids of a joined text tell its chunks apart.
        """
        for k in range(0, len(chunks), 1000):
            part = chunks[k : k + 1000]
            ids = np.array(self.tok.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            at = np.append(np.flatnonzero(self.leads[ids]), len(ids))
            if len(at) != len(part) + 1:  # chunks with white space at their ends
                each = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
                ids, at = np.array([i for x in each for i in x], "<u4"), np.cumsum([0, *map(len, each)])
            yield ids, at

    def encoded(self, chunks: list[str]) -> list:
        raise NotImplementedError

    def values_of(self, keys: list[str]) -> list:
        """Values of some keys, None of those that aren't cut off at a boundary; one call encodes all that the table lacks.

        Keys of the latter kind never enter the table, so only what it lacks is looked at.
        """
        found = list(map(self.get, keys))
        if None in found:
            lacking = [k for k, v in zip(keys, found, strict=True) if v is None and is_cut(k)]
            fresh = dict(zip(lacking, self.encoded([k if k[:1] == "\n" else " " + k for k in lacking]), strict=True))
            found = [fresh.get(k) if v is None else v for k, v in zip(keys, found, strict=True)]
            room = self.cap - len(self)
            if room > 0:
                self.update([(k, v) for k, v in fresh.items() if len(k) <= KEY_CHARS][:room])
        return found

    def whole(self, text: str):
        """The value of a text that the chunk rule doesn't cover."""
        raise NotImplementedError

    def joined(self, parts: list):
        """The value of a text from those of its chunks."""
        raise NotImplementedError

    def alone(self, text: str):
        """The value of one text, chunk by chunk where the rule holds."""
        if not self.plain or any(s in text for s in self.special):
            return self.whole(text)
        first, keys = chunks_of(text)
        return self.joined([self.whole(first), *self.values_of(keys)])

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """Texts as rows of chunks: ``(starts, which, values, odd)``.

        Chunks of text ``k`` begin at ``starts[k]``; ``which`` is the place of a
        chunk's value in ``values``, which has first chunks at the end.  ``odd``
        are the texts whose values must come from :meth:`alone`.
        """
        if pc.sum(pc.binary_length(texts)).as_py() > 1 << 29:  # room for what the line feeds add
            texts = texts.cast(pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = np.asarray(lists.offsets)[:-1].astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes, n = np.asarray(coded.indices), len(coded.dictionary)
        later = np.ones(len(codes), bool)
        later[starts] = False
        place = np.zeros(n, np.int64)
        place[codes[later]] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        which = place[codes]
        which[starts] = len(used) + np.arange(len(starts))
        values = self.values_of(coded.dictionary.take(pa.array(used)).to_pylist())
        odd = np.zeros(len(starts), bool)
        if None in values:
            bad = np.zeros(len(used) + len(starts), bool)
            bad[: len(used)] = [v is None for v in values]
            odd |= np.logical_or.reduceat(bad[which], starts)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        heads = coded.dictionary.take(pa.array(codes[starts])).to_pylist()
        return starts, which, values + self.encoded_first(heads), np.flatnonzero(odd)

    def encoded_first(self, heads: list[str]) -> list:
        return list(map(self.whole, heads))


class ChunkCounter(ChunkTable):
    """Numbers of tokens: whole tokens count one each, chunks with any other pre-token are merged."""

    def __init__(self, path: str, cap: int = CHUNK_TABLE):
        import regex

        super().__init__(path, cap)
        self.proven = frozenset(whole_tokens(self.tok))
        self.pretokens = regex.compile(_BYTE_LEVEL_SPLIT).findall

    def encoded(self, chunks: list[str]) -> list[int]:
        whole, out, rest = self.proven, [0] * len(chunks), []
        for k, c in enumerate(chunks):
            if c in whole:
                out[k] = 1
            elif c[1:].isalpha() or not whole.issuperset(parts := self.pretokens(c)):
                rest.append(k)
            else:
                out[k] = len(parts)
        counts = (n for _, at in self.merged([chunks[k] for k in rest]) for n in np.diff(at).tolist())
        for k, n in zip(rest, counts, strict=True):
            out[k] = n
        return out

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False)) if text else 0

    def encoded_first(self, heads: list[str]) -> list[int]:
        return list(map(len, self.tok.encode_batch_fast(heads, add_special_tokens=False))) if heads else []

    def joined(self, parts: list[int]) -> int:
        return sum(parts)

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Counts of some texts."""
        if not self.plain:
            return np.array(list(map(self.alone, texts.to_pylist())), np.int64)
        starts, which, values, odd = self.split(texts)
        if not len(starts):
            return np.zeros(0, np.int64)
        n = np.add.reduceat(np.array([v or 0 for v in values], np.int64)[which], starts)
        for k in odd.tolist():
            n[k] = self.alone(texts[k].as_py())
        return n


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Slices of about ``most`` bytes, of one text at least; nulls become empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


@lru_cache(maxsize=2)
def text_counter(path: str):
    """A function from an array of texts to token counts for a ``.json`` or ``.model`` file; a worker keeps it for its next tasks."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda ts: [len(x) for x in sp.encode(ts.to_pylist(), num_threads=1)]
    if not is_plain_byte_level(path):
        tok = load_tokenizer(path)
        return lambda ts: [len(tok.encode(t, add_special_tokens=False)) for t in ts.to_pylist()]
    return ChunkCounter(path).count_all


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Exact token counts of every whole text, in one pass without a shuffle.

    Null and empty texts count 0 bytes and 0 tokens; rows with a null or a
    repeated id each give a row; other columns, whatever their names, are
    ignored; an empty table gives an empty result.  A text is never split
    between tasks: one of any length takes memory in proportion to it.  Returns ``doc_id, n_bytes, n_tokens, over_limit``.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def make():
        count = text_counter(tokenizer_path)

        def step(batch: pa.RecordBatch) -> Iterable[dict]:
            for at, ts in slices(batch.column(1)):
                n = np.asarray(count(ts), np.int64)
                yield {"doc_id": batch.column(0).slice(at, len(ts)), "n_bytes": pc.binary_length(ts).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

        return step

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return arrow_map(picked, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, out)

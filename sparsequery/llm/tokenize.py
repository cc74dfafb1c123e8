"""Encoding of whole corpora with a byte-level BPE vocabulary by prefix dynamic programming.

Every prefix of a byte string has exactly one last token in its BPE encoding, so an encoding is a chain of "last
tokens". For prefix ``i`` the last token is the one token ending at ``i`` that may follow the last token of the
prefix it starts from. Storing these per prefix allows exact appends (only new prefixes are computed) and
re-encoding near an edit (prefixes before the edit stay).

The corpus path splits texts into pretokens with NumPy over code points and runs the prefix programme once per distinct
pretoken and Python worker. Equal pretokens of a block are found by a hash, but their bytes are compared: a pretoken that
only shares the hash is encoded by itself. What a worker remembers is bounded. The vocabulary travels from the driver to
the workers, which need no file of their own.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

# The code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = "sdmt", ("re", "ve", "ll")

MASK = (1 << 64) - 1
HASH_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
REMEMBERED = 1 << 20  # distinct pretokens, ids or token pairs that a worker keeps before it starts anew


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: white space, letter (L*), number (N*) or other."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE_SPACE] = SPACE
    return t


def _byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class PrefixEncoder:
    """Prefix dynamic programming over one vocabulary (JSON with ``vocab`` and ordered ``merges``): a path, or the file's bytes."""

    def __init__(self, vocabulary: str | bytes = DEFAULT_VOCABULARY):
        model = json.loads(vocabulary if isinstance(vocabulary, bytes) else vocabulary_bytes(vocabulary))["model"]
        sym = _byte_symbols()
        raw = lambda s: bytes(sym[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in sym for c in s)}
        self.longest = max(map(len, self.ids))
        rank = {b: -1 for b in self.ids}  # place in the merge order; -1 for single bytes
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for n, m in enumerate(model["merges"]):
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            if a + b not in self.parts and a + b in self.ids:
                self.parts[a + b], rank[a + b] = (a, b), n
        # a special token that is no merge result can't be reached from bytes
        self.ids = {b: i for b, i in self.ids.items() if len(b) == 1 or b in self.parts}
        self.rank = rank
        self.known: dict[tuple[bytes, bytes], bool] = {}

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves ``left`` and ``right`` as two tokens when they stand next to each other.

        Their merges are undone from the latest one; at each moment the two pieces that touch must not have a
        merge of their own that came before the next undone one.
        """
        key = (left, right)
        hit = self.known.get(key)
        if hit is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            hit = self.known[key] = self._follows(left, right)
        return hit

    def _follows(self, left: bytes, right: bytes) -> bool:
        rank, undone, strict = self.rank, len(self.rank) + len(self.parts), False
        while True:
            joint = left + right
            if joint in self.parts and self.parts[joint] == (left, right):
                r = rank[joint]
                # equal ranks mean the same merge twice in a row; the one further left is done first
                if r < undone or (r == undone and strict):
                    return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # ties: the same token on both sides; the right one was formed later
            if a > b:
                undone, left, strict = a, self.parts[left][1], False
            else:
                undone, right, strict = b, self.parts[right][0], True

    def last_tokens(self, data: bytes, last: list[bytes] | None = None) -> list[bytes]:
        """The last token of every prefix; with ``last`` of a shorter prefix, only the new ones are computed."""
        last = list(last or [])
        ids = self.ids
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                t = data[start:end]
                if t in ids and (start == 0 or self.follows(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return last

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        if data in self.ids:
            return [self.ids[data]]
        last = self.last_tokens(data)
        out, end = [], len(data)
        while end:
            out.append(self.ids[last[end - 1]])
            end -= len(last[end - 1])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text; null and empty texts have none."""
        if not text:
            return []
        data = text.encode("utf-8")
        starts, _ = pretokens(data, np.zeros(1, np.int64))
        return [i for a, b in zip(starts[:-1], starts[1:]) for i in self.encode_piece(data[a:b])]

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """Ids of ``text + more`` given the ids of ``text``; only the end of ``text`` is encoded again.

        Appending can't move a pretoken boundary that lies before the last two pretokens of ``text``.
        """
        data = text.encode("utf-8")
        starts, _ = pretokens(data, np.zeros(1, np.int64))
        keep = int(starts[max(0, len(starts) - 3)])
        tail = data[keep:].decode("utf-8")
        kept = len(ids) - len(self.encode(tail))
        return ids[:kept] + self.encode(tail + more)

    def edit(self, text: str, ids: list[int], start: int, stop: int, new: str) -> tuple[str, list[int]]:
        """Text and ids after ``text[start:stop]`` became ``new``; pretokens away from the edit keep their ids."""
        out = text[:start] + new + text[stop:]
        old, now = text.encode("utf-8"), out.encode("utf-8")
        a = [int(x) for x in pretokens(old, np.zeros(1, np.int64))[0]] if old else [0]
        b = [int(x) for x in pretokens(now, np.zeros(1, np.int64))[0]] if now else [0]
        pa, pb = [old[i:j] for i, j in zip(a, a[1:])], [now[i:j] for i, j in zip(b, b[1:])]
        head = 0
        while head < min(len(pa), len(pb)) and pa[head] == pb[head]:
            head += 1
        tail = 0
        while tail < min(len(pa), len(pb)) - head and pa[-1 - tail] == pb[-1 - tail]:
            tail += 1
        n = [len(self.encode_piece(p)) for p in pa]
        left, right = sum(n[:head]), sum(n[len(n) - tail :]) if tail else 0
        middle = [i for p in pb[head : len(pb) - tail] for i in self.encode_piece(p)]
        return out, ids[:left] + middle + (ids[len(ids) - right :] if right else [])


def pretokens(data: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pretokens start (with the end of ``data``), and the index of the first of each text.

    ``text_starts``: byte offsets of the texts in ``data``. The rules are those of the vocabulary's published
    pattern: contractions, then runs of letters, numbers or other marks with one leading blank, then white space
    without its last character if something follows.
    """
    cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(text_starts), np.int64)
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.empty(n + 1, np.int64)
    at[0] = 0
    np.cumsum(width, out=at[1:])
    first = np.zeros(n + 1, bool)  # first character of a text
    first[np.searchsorted(at, text_starts)] = True
    first[n] = True
    kind = _classes()[cp]
    cut = first.copy()  # a token starts here
    cut[1:n] |= kind[1:] != kind[:-1]
    blank = np.zeros(n + 1, bool)  # a blank before this character, in the same text
    blank[1:n] = cp[:-1] == 0x20
    blank &= ~first
    space = np.zeros(n + 1, bool)
    space[:n] = kind == SPACE
    run_start = cut.copy()
    cut &= space | ~blank | first  # a run takes the blank before it along
    tail = np.zeros(n, bool)  # the last white space before something else
    tail[:-1] = space[: n - 1] & ~space[1:n] & ~first[1:n]
    cut[:n] |= tail
    # contractions: a lone apostrophe without a blank before it, then certain letters
    mark = np.flatnonzero((cp == 0x27) & run_start[:n] & ~blank[:n])
    mark = mark[mark + 1 < n]
    mark = mark[run_start[mark + 1] & ~first[mark + 1]]
    if len(mark):
        padded = np.append(cp, [0, 0])
        c1, c2 = padded[mark + 1], padded[mark + 2]
        same = ~first[np.minimum(mark + 2, n)]
        size = np.where(np.isin(c1, [ord(c) for c in SHORT_CONTRACTIONS]), 1, 0)
        for s in LONG_CONTRACTIONS:
            size = np.where((size == 0) & (c1 == ord(s[0])) & (c2 == ord(s[1])) & same, 2, size)
        mark, size = mark[size > 0], size[size > 0]
        cut[mark + 1] = False
        end = mark + 1 + size
        inside = end[(end < n)]
        # where the run of letters goes on, its rest is a token of its own
        cut[inside[(kind[inside] == LETTER) & ~first[inside]]] = True
    where = np.flatnonzero(cut)
    return at[where], np.searchsorted(at[where], text_starts)


class CorpusEncoder:
    """Encodes blocks of texts; remembers the ids of up to ``remember`` distinct pretokens it has met."""

    def __init__(self, vocabulary: str | bytes = DEFAULT_VOCABULARY, block: int = 1 << 20, remember: int = REMEMBERED):
        self.dp, self.block, self.remember = PrefixEncoder(vocabulary), block, remember
        self._forget()
        inverse = pow(HASH_BASE, -1, 1 << 64)
        self.power = self._powers(HASH_BASE, block)
        self.inverse = self._powers(inverse, block)

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.sizes, self.starts, self.flat = [], [], []

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(p, dtype=np.uint64)

    def _hashes(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):  # a single very long text
            self.power = self._powers(HASH_BASE, len(raw))
            self.inverse = self._powers(pow(HASH_BASE, -1, 1 << 64), len(raw))
        with np.errstate(over="ignore"):
            h = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=h[1:])
            a, b = starts[:-1], starts[1:]
            return (h[b] - h[a]) * self.inverse[a]

    def _slot(self, piece: bytes) -> int:
        s = self.slot.get(piece)
        if s is None:
            s = self.slot[piece] = len(self.sizes)
            ids = self.dp.encode_piece(piece)
            self.starts.append(len(self.flat))
            self.sizes.append(len(ids))
            self.flat += ids
        return s

    def block_ids(self, data: bytes, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, and the offset at which each text's ids start."""
        starts, first = pretokens(data, text_starts)
        if len(starts) < 2:
            return np.zeros(0, np.int32), np.zeros(len(text_starts) + 1, np.int64)
        if len(self.slot) >= self.remember or len(self.flat) >= 8 * self.remember:
            self._forget()
        raw = np.frombuffer(data, np.uint8)
        _, where, back = np.unique(self._hashes(raw, starts), return_index=True, return_inverse=True)
        slots = np.fromiter((self._slot(data[a:b]) for a, b in zip(starts[where].tolist(), starts[where + 1].tolist())), np.int64, len(where))[back]
        # the bytes of every pretoken against those of the one its hash was looked up by
        own, alike = np.diff(starts), starts[where][back]
        wrong = own != (starts[where + 1] - starts[where])[back]
        shift = np.where(wrong, 0, alike - starts[:-1])
        differ = raw[np.arange(len(raw)) + np.repeat(shift, own)] != raw
        if differ.any():
            wrong[np.searchsorted(starts, np.flatnonzero(differ), "right") - 1] = True
        for i in np.flatnonzero(wrong).tolist():
            slots[i] = self._slot(data[starts[i] : starts[i + 1]])
        size, begin = np.asarray(self.sizes, np.int64)[slots], np.asarray(self.starts, np.int64)[slots]
        ends = np.cumsum(size)
        total = int(ends[-1])
        pick = np.arange(total) + np.repeat(begin - (ends - size), size)
        offsets = np.append(0, ends)[np.append(first, len(size))]
        return np.asarray(self.flat, np.int32)[pick], offsets

    def blocks(self, texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, ids, offsets) over an Arrow string array, in blocks of about ``block`` bytes; nulls are empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
        raw = memoryview(buf) if buf is not None else memoryview(b"")
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + self.block, "right")) - 1)
            j = min(j, n)
            ids, at = self.block_ids(bytes(raw[off[i] : off[j]]), off[i:j] - off[i])
            yield i, j, ids, at
            i = j


_ENCODERS: dict[int, CorpusEncoder] = {}
_SENT: dict[tuple[str, str], Broadcast] = {}


def corpus_encoder(vocabulary: Broadcast) -> CorpusEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary.value[0] not in _ENCODERS:
        _ENCODERS[vocabulary.value[0]] = CorpusEncoder(vocabulary.value[1])
    return _ENCODERS[vocabulary.value[0]]


def send_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's bytes, read on the driver and sent once per session; it may have at most 256 MB."""
    key = spark.sparkContext.applicationId, path
    if key not in _SENT:
        data = vocabulary_bytes(path)
        if len(data) > 1 << 28:
            raise ValueError(f"{path} is too large for a vocabulary")
        _SENT[key] = spark.sparkContext.broadcast((hash(data), data))
    return _SENT[key]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ``ids`` array<int>), one row per row of ``docs``; null and empty texts give an empty list.

    A narrow map over two columns: no shuffle, whatever the size; repeated ids keep their rows, other columns are
    ignored, very long texts are encoded whole.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = corpus_encoder(sent)
        for b in batches:
            for i, j, ids, at in enc.blocks(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=[id_col, "ids"])

    workers(docs.sparkSession)
    sent = send_vocabulary(docs.sparkSession, vocabulary)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__sq_text"))
    kind = dict(src.dtypes)[id_col]
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` (bigint), one row per row of ``docs``; null and empty texts have 0."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = corpus_encoder(sent)
        for b in batches:
            n = [np.diff(at) for _, _, _, at in enc.blocks(b.column(b.num_columns - 1))]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    workers(docs.sparkSession)
    sent = send_vocabulary(docs.sparkSession, vocabulary)
    src = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__sq_text"))
    schema = ", ".join(f"`{c}` {k}" for c, k in src.dtypes[:-1])
    return src.mapInArrow(run, f"{schema}, n_tokens bigint")

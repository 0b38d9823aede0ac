"""Packing along a space-filling curve.

Each document's token ids are hashed to random directions of a few dimensions and added up; the
direction of the sum is quantised and turned into its Hilbert key. Documents are range-sorted by
that key, and each range is cut into full sequences as it is read, so a sequence holds neighbours
on the curve. What remains at a range's end is cut at powers of two, which need no padding. Long
documents are sorted as rows of SORTED_TOKENS, so that ranges of about as many rows hold about as
many bytes.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Tokens of a document in one row of the range sort.
SORTED_TOKENS = 2048
#: Bytes of ids in a range of the curve, about: the number of ranges follows the input.
RANGE_BYTES = 32 << 20
DIMENSIONS = 4
BITS = 10
#: Words of a generation whose ids a task remembers; at most two generations.
REMEMBERED = 350_000
#: Bytes of the longest word that is remembered.
LONGEST_REMEMBERED = 64
#: Bytes of a text, and texts, that are taken into words at once.
LONG_TEXT = 1 << 21
ROWS_AT_ONCE = 1024
#: New words that are encoded at once: the tokenizer's own records take a hundred times the ids' bytes.
NEW_AT_ONCE = 4096
_SPACE = re.compile(rb"[\x20\x09-\x0d]")

_memory: dict[str, _Words] = {}


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words:
    """A worker's tokenizer and the ids of words its task has met lately: those of two generations."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run beside each other already; threads keep memory each
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.is_end = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _ask(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, fresh: list[bytes]) -> None:
        """Encodes new words. Those of letters alone go in one text: each ends with its one word-end id."""
        plain, other = [], []
        for w in fresh:
            (plain if w.decode("utf-8", "replace").isalpha() else other).append(w)
        if plain:
            ids = np.array(self._ask([b" ".join(plain).decode()])[0], self.dtype)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                raw, step, a = ids.tobytes(), self.dtype.itemsize, 0
                for w, b in zip(plain, (ends * step).tolist()):
                    self.now[w] = raw[a:b]
                    a = b
            else:
                other += plain
        for w, ids in zip(other, self._ask([w.decode("utf-8", "replace") for w in other])):
            self.now[w] = np.array(ids, self.dtype).tobytes()

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words, those met before from memory."""
        if len(self.now) > REMEMBERED:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        fresh = []
        for w in words:
            if w not in now:
                known = before.get(w)
                if known is None:
                    fresh.append(w)
                else:
                    now[w] = known
        # A full stop or comma after a letter is a token of its own.
        tails = [w for w in fresh if len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122]
        stems = {x for w in tails for x in (w[:-1], w[-1:])}.union(fresh).difference(tails)
        for x in [x for x in stems if x in before]:
            now[x] = before[x]
        unknown = [x for x in stems if x not in now]
        for a in range(0, len(unknown), NEW_AT_ONCE):
            self.learn(unknown[a : a + NEW_AT_ONCE])
        for w in tails:
            now[w] = now[w[:-1]] + now[w[-1:]]
        found = [now[w] for w in words]
        for w in [w for w in fresh if len(w) > LONGEST_REMEMBERED]:
            now.pop(w, None)
        return found

    def forget(self) -> None:
        """Gives the words' memory back: a worker lives on after its task, and serves other stages."""
        self.now, self.before = {}, {}
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end). Words are told apart in Arrow, looked up once each."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self.ids_of(coded.dictionary.cast(pa.binary()).to_pylist())
        pool = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        word = coded.indices.to_numpy()
        lengths = size[word]
        ends = np.cumsum(lengths)
        begin = (np.cumsum(size) - size)[word] - (ends - lengths)
        place = np.repeat(begin, lengths)
        place += np.arange(len(place))
        ids = pool[place]
        words_upto = np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]))
        return ids, np.concatenate([[0], ends])[words_upto]


def _words(path: str) -> _Words:
    if path not in _memory:
        _memory[path] = _Words(path)
    return _memory[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of each text are what the tokenizer gives for the whole text; null has none.

    The tokenizer never joins what white space parts and ignores the case of A-Z, so a text's ids
    are those of its words; each word is encoded once and remembered. Special tokens keep their case.
    """
    words = _words(path)
    texts = texts.fill_null("")
    special = pc.match_substring(texts, "<|")
    cased = pc.if_else(special, texts, pc.ascii_lower(texts))
    sizes = pc.binary_length(cased).to_numpy()
    long_ = np.flatnonzero(sizes > LONG_TEXT)
    if not len(long_):
        return words.encode(cased)
    rows = []
    for at in range(len(cased)):
        raw = cased[at].as_py().encode("utf-8", "surrogatepass")
        rows.append(np.concatenate([words.encode(pa.array([part.decode()]))[0] for part in _parts(raw)] or [np.zeros(0, words.dtype)]))
    return np.concatenate(rows), np.cumsum([0, *map(len, rows)])


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at white space, so that memory for its words is bounded."""
    at = 0
    while at < len(text):
        end = at + LONG_TEXT
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points (n, d) with coordinates under 2**bits along Hilbert's curve, d * bits < 64."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(d):
            there = (x[i] & q) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _directions(seed: int = 11, size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, DIMENSIONS)).astype(np.float32)


def curve_keys(ids: np.ndarray, offsets: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The key of each text, none of them without ids."""
    sums = np.add.reduceat(directions[ids & (len(directions) - 1)], offsets[:-1], axis=0, dtype=np.float64)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cells = np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS)


def _encoder(path: str) -> Callable:
    def coded(whole: pa.RecordBatch, directions: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(a, ROWS_AT_ONCE)
            ids, offsets = encode(batch.column("text"), path)
            ids, offsets = np.insert(ids, offsets[1:], END_ID), offsets + np.arange(len(offsets))
            keys, lengths = curve_keys(ids, offsets, directions), np.diff(offsets)
            parts = -(-lengths // SORTED_TOKENS)
            row = np.repeat(np.arange(len(parts)), parts)
            start = (np.arange(len(row)) - (np.cumsum(parts) - parts)[row]) * SORTED_TOKENS
            at = np.append(offsets[row] + start, offsets[-1]) * ids.itemsize
            raw = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(at.astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
            columns = [
                batch.column("doc_id").take(pa.array(row)), pa.array(keys[row], pa.int64()), pa.array(start, pa.int64()),
                pa.array(lengths[row], pa.int64()), pa.array(np.diff(at), pa.int64()), raw.cast(pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "curve", "start", "doc_tokens", "size", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions()
        try:
            for whole in batches:
                yield from coded(whole, directions)
        finally:
            _words(path).forget()

    return run


def _cut(length: int, most: int) -> list[int]:
    """A range's last sequence, shorter than the rest: its length as a sum of powers of two."""
    return [most] if length == most else [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _packer(most: int, path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        stored = _words(path).dtype
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the open sequence
        filled = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal sequence, held, filled
            for room in _cut(filled, most):
                offset = 0
                while offset < room:
                    doc, start, ids, n = held.pop(0)
                    take = min(len(ids) // 4, room - offset)
                    out.append((doc, start, take, zlib.crc32(ids[: 4 * take]), n, sequence, offset))
                    if 4 * take < len(ids):
                        held.insert(0, (doc, start + take, ids[4 * take :], n))
                    offset += take
                sequence += 1
            filled = 0

        def batch_of(schema: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            kinds = [schema, *[pa.int64()] * 6]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            told = (batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
            for doc, start, tokens, value in zip(*told, batch.column("ids")):
                ids = np.frombuffer(value.as_py(), stored).astype("<u4").tobytes()
                n, at = len(ids) // 4, 0
                while at < n:
                    take = min(n - at, most - filled)
                    held.append((doc, start + at, ids[4 * at : 4 * (at + take)], tokens))
                    filled += take
                    at += take
                    if filled == most:
                        close()
                if len(out) > 8192:
                    yield batch_of(kind)
        if filled:
            close()
        if kind is not None:
            yield batch_of(kind)

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids, an end id after them, lie in pieces that follow each other; a null or
    empty text has the end id alone. Rows with equal doc_ids are packed each for itself. An empty
    table gives an empty one. Only doc_id and text are read. ``sequence_tokens`` is a power of two.
    """
    path = tokenizer_path or public_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]
    coded = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _encoder(path), f"doc_id {kind}, curve bigint, start bigint, doc_tokens bigint, size bigint, ids binary"
    )
    # Written once: the range bounds are sampled from it, and tokenizing twice would cost more than reading.
    coded = materialise(coded, "token-ids")
    held = coded.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first().bytes
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    rows = coded.select("doc_id", "curve", "start", "doc_tokens", "ids")
    ordered = rows.repartitionByRange(ranges, "curve", "doc_id", "start").sortWithinPartitions("curve", "doc_id", "start", "ids")
    return ordered.mapInArrow(
        _packer(sequence_tokens, path),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )

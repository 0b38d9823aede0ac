"""Language identification by error-correcting output codes.

Every language has a binary codeword. For each bit a linear n-gram classifier tells the languages
whose bit is 1 from the others: its weights are log ratios of smoothed byte-trigram frequencies,
each language counting alike. Decoding weighs each bit's logistic loss by how well the bit's two
sides differ, and chooses the codeword of least loss; a near second marks the row as ambiguous.

Trigram counts cover all training rows and every language. They are added up on the executors, first by
language, then by bit: what comes to the driver are the languages' names and one number for each bit and
hashed trigram, and the bits grow with the logarithm of the languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

HASH_BITS = 13
#: Added to every trigram count.
SMOOTHING = 0.5
#: Two least losses nearer than this mark a row as ambiguous.
AMBIGUOUS = 0.1
#: Up to so many languages codewords are chosen from several draws, by their distance.
CHOSEN_CODES = 1024
#: Languages whose counts a task holds at a time.
HELD_LANGS = 256
#: Labels that name languages; more are no languages, and an error.
MOST_NAMES = 1 << 20
#: A text of so many letters, or more, of which no bit can be told is in none of the learned languages:
#: its least loss is nearly that of guessing every bit. (A mixture of two has bits that both agree on.)
TELLING_LETTERS = 200
UNDECIDED = 0.9
#: Bytes scored at a time, so that a very long text takes no more memory than others.
WINDOW = 1 << 19
_LETTER = regex.compile(r"\p{L}")
#: Bytes that aren't a-z or part of a non-ASCII character count as space.
_TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def telling(text: str) -> bool:
    """Whether a text has TELLING_LETTERS letters."""
    return sum(1 for _ in islice(_LETTER.finditer(text), TELLING_LETTERS)) == TELLING_LETTERS


def _segments(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashed trigrams) of whole texts, window by window."""
    for row, text in enumerate(texts):
        if text is None:
            continue
        clean = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()) + b" "
        data = np.frombuffer(clean, np.uint8).astype(np.uint32)
        for a in range(0, max(len(data) - 2, 0), WINDOW):
            part = data[a : a + WINDOW + 2]
            packed = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            yield row, (packed * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)


def codewords(n_langs: int) -> np.ndarray:
    """(n_langs, bits) of +1 and -1, no two rows equal: all splits of up to 5 languages, else random ones well apart."""
    if n_langs <= 1:
        return np.ones((n_langs, 1))
    if n_langs <= 5:
        columns = [[1 if lang == 0 or (c >> (lang - 1)) & 1 else -1 for lang in range(n_langs)] for c in range(2 ** (n_langs - 1) - 1)]
        return np.array(columns, float).T
    bits = 8 * int(np.ceil(np.log2(n_langs)))
    rng = np.random.default_rng(5)
    best, apart = None, -1
    if n_langs > CHOSEN_CODES:
        while True:  # two of so many bits are hardly ever equal
            code = rng.choice([-1.0, 1.0], (n_langs, bits))
            if len(np.unique(code, axis=0)) == n_langs:
                return code
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n_langs, bits))
        code = code[:, np.abs(code.sum(0)) < n_langs]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n_langs) * code.shape[1]
        if distance.min() > apart:
            best, apart = code, distance.min()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (langs, bits)
    weights: np.ndarray  # (hashed trigrams, bits)
    bit_weight: np.ndarray  # (bits,), sums to the count of bits

    def losses(self, texts: list[str | None]) -> np.ndarray:
        sums, n = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        rows, held, size = [], [], 0

        def flush() -> None:
            if rows:
                starts = np.cumsum([0] + [len(h) for h in held[:-1]])
                np.add.at(sums, rows, np.add.reduceat(self.weights[np.concatenate(held)], starts, axis=0, dtype=np.float64))
                np.add.at(n, rows, [len(h) for h in held])

        for row, grams in _segments(texts):
            if len(grams):
                rows.append(row)
                held.append(grams)
                size += len(grams)
            if size >= WINDOW:
                flush()
                rows, held, size = [], [], 0
        flush()
        z = np.clip(sums / np.sqrt(np.maximum(n, 1))[:, None], -30, 30)
        # A bit costs one thing where a codeword has 1 and another where it has -1.
        yes, no = np.log1p(np.exp(-z)) * self.bit_weight, np.log1p(np.exp(z)) * self.bit_weight
        return yes @ (self.code > 0).T + no @ (self.code < 0).T

    def undecided(self, loss: np.ndarray) -> np.ndarray:
        return loss.min(1) >= UNDECIDED * np.log(2) * self.bit_weight.sum()

    def predict(self, texts: list[str | None], loss: np.ndarray | None = None) -> tuple[list[str], list[float], list[bool]]:
        """Language, score in 0 to 1 and ambiguity of each text; und, 0 and True where there is no letter."""
        loss = self.losses(texts) if loss is None else loss
        best = loss.argmin(1)
        least = loss[np.arange(len(texts)), best]
        share = np.exp(least[:, None] - loss)
        score = 1 / share.sum(1)
        second = np.where(np.arange(loss.shape[1]) == best[:, None], np.inf, loss).min(1)
        near = second - least < AMBIGUOUS
        known = [has_letter(t) for t in texts]
        return (
            [self.langs[b] if k else "und" for b, k in zip(best, known)],
            [float(s) if k else 0.0 for s, k in zip(score, known)],
            [bool(x) or not k for x, k in zip(near, known)],
        )


def held_out():
    """Rows that no classifier learns from: crc32 of the doc_id as text divides by 5 (a null doc_id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "gram", "n"])

    for batch in batches:
        for a in range(0, batch.num_rows, HELD_LANGS):
            langs = batch.column("lang").slice(a, HELD_LANGS).to_pylist()
            for row, grams in _segments(batch.column("text").slice(a, HELD_LANGS).to_pylist()):
                own = counts.setdefault(langs[row], np.zeros(1 << HASH_BITS, np.int64))
                own += np.bincount(grams, minlength=1 << HASH_BITS)
            if len(counts) > HELD_LANGS:
                yield from told()
                counts.clear()
    yield from told()


def _by_bit(ones: np.ndarray) -> Callable:
    """(place of the language, gram, share) -> (gram, sums over languages: of all, then of those with each bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1 << HASH_BITS, ones.shape[1]))
        for batch in batches:
            place, gram, share = (batch.column(c).to_numpy() for c in ("place", "gram", "share"))
            np.add.at(sums, gram, share[:, None] * ones[place])
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(sums[at]), pa.list_(pa.float64()))], ["gram", "sums"])

    return run


def fit(labelled: DataFrame) -> Model | None:
    """labelled(text, lang), nulls left out -> the model of all its languages; None if there is nothing to learn from."""
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counts = materialise(rows.mapInArrow(_count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(MOST_NAMES + 1).collect()
    if len(totals) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} different labels: these are no languages")
    langs = sorted(r.lang for r in totals)
    if not langs:
        return None
    code = codewords(len(langs))
    if len(langs) == 1:
        return Model(langs, code, np.zeros((1 << HASH_BITS, 1), np.float32), np.ones(1))
    place = {lang: i for i, lang in enumerate(langs)}
    whole = np.zeros(len(langs))
    for r in totals:
        whole[place[r.lang]] = r.total + SMOOTHING * (1 << HASH_BITS)
    ones = np.concatenate([np.ones((len(langs), 1)), code > 0], axis=1)
    named = spark.createDataFrame([(lang, i, float(whole[i])) for lang, i in place.items()], "lang string, place int, whole double")
    shares = counts.join(named, "lang").select("place", "gram", (F.col("n") / F.col("whole")).alias("share"))
    bits = shares.mapInArrow(_by_bit(ones), "gram int, sums array<double>").groupBy("gram").agg(*[F.sum(F.get("sums", F.lit(b))).alias(f"b{b}") for b in range(ones.shape[1])])
    sums = np.zeros((1 << HASH_BITS, ones.shape[1]))
    for r in bits.collect():
        sums[r[0]] = r[1:]
    sums = (sums + SMOOTHING * (1 / whole) @ ones).T  # a language's trigrams that it never had count as SMOOTHING each
    n = ones.sum(0)
    yes, no = sums[1:] / n[1:, None], (sums[0] - sums[1:]) / (n[0] - n[1:])[:, None]
    weights = np.log(yes) - np.log(no)
    apart = ((yes - no) * weights).sum(1)
    weight = apart / apart.sum() * len(apart) if apart.sum() > 0 else np.ones(len(apart))  # languages of the same words: no bit tells
    return Model(langs, code, np.ascontiguousarray(weights.T, np.float32), weight)


def _predictor(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                texts = batch.column("text").to_pylist()
                lang, score, near = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts), [True] * len(texts))
                added = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())]
                kept = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *added], [*kept, "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from text and non-null lang of the rows that aren't held out; a prediction reads the
    whole text and nothing else. lang_pred is a learned value, or und (score 0, ambiguous) where
    text is null, empty or without a letter, or where no row could be learned from. Equal texts get
    equal results. An empty table gives an empty one; other columns don't matter.
    """
    model = fit(docs.where(~held_out()))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        _predictor(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def drop_unidentified(docs: DataFrame, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows whose language is found, with all their columns.

    What has no letter goes, and so does a text of TELLING_LETTERS letters or more that is ambiguous and
    of which no bit can be told: it is in none of the learned languages. Shorter ambiguous texts and
    mixtures of languages stay. With ``languages``, only those stay. Where no row is labelled nothing is learned and
    only what has no letter goes.
    """
    model = fit(docs.where(~held_out()))

    @F.arrow_udf("boolean")
    def stays(text: pa.Array) -> pa.Array:
        found: list[bool] = []
        for a in range(0, len(text), 1024):
            part = text.slice(a, 1024).to_pylist()
            if model is None:
                found += [has_letter(t) for t in part]
                continue
            loss = model.losses(part)
            langs, _, near = model.predict(part, loss)
            found += [
                lang != "und" and (languages is None or lang in languages) and not (unclear and lost and telling(t))
                for t, lang, unclear, lost in zip(part, langs, near, model.undecided(loss))
            ]
        return pa.array(found, pa.bool_())

    return docs.where(stays(F.col("text").cast("string")))

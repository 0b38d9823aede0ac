"""Licence scan: fuzzy search for short notices.

A notice with k allowed edits is cut into k + 1 pieces; by the pigeonhole principle one of them
stands unchanged in every place where the notice occurs with k edits or fewer. Exact search for the
pieces gives candidate places; the regex library's bounded-error matching verifies each and tells
span and edits.
"""

from __future__ import annotations

import bisect
import heapq
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices searched with edits: phrase, label, allowed edits.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("apache license version 2 0", "apache", 2),
    ("apache license", "apache", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("bsd 2 clause license", "bsd", 1),
    ("bsd 3 clause license", "bsd", 1),
    ("creative commons attribution", "cc-by", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("this is free and unencumbered software", "unlicense", 3),
    ("licensed under the mit license", "mit", 2),
    ("the mit license", "mit", 1),
    ("mit license", "mit", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by", "cc-by", 0),
    ("public domain dedication", "public-domain", 2),
)

#: Windows whose best match is remembered, since notices repeat.
REMEMBERED = 1 << 14

#: Word bytes stay, A-Z in lower case; all others count as space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Hit:
    label: str
    first_word: int
    n_words: int
    start: int  # of the normalised text, words parted by one space each
    end: int
    edits: int
    similarity: float


def normalise(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_WORDS).split())


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase cut into edits + 1 pieces of about equal length, each with its place."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def _windows(places: list[tuple[int, int]], apart: int) -> list[tuple[int, int]]:
    """Windows that begin at most ``apart`` after a first one joined to it, so none gets much longer than one seed's."""
    out: list[tuple[int, int]] = []
    first = 0
    for a, b in sorted(places):
        if out and a <= first + apart:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            first = a
            out.append((a, b))
    return out


class Scanner:
    def __init__(self, notices: tuple = NOTICES):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (phrase, _, edits) in enumerate(notices):
            for at, piece in pieces(phrase, edits):
                found.setdefault(piece, []).append((i, at))
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        # Best match within a window; word borders are not edited away.
        self.patterns = [regex.compile(rf"(?<![^ ])(?b:(?:{regex.escape(p)}){{e<={k}}})(?![^ ])") for p, _, k in notices]
        self.best = lru_cache(maxsize=REMEMBERED)(self._best)

    def _best(self, i: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of a notice's best match in a window, whose first and last characters stand around it."""
        end = len(window) - 1
        m = self.patterns[i].search(window, 1, end)
        while m and m.end() == end and window[end] != " ":  # the word goes on behind the match
            end -= 1
            m = self.patterns[i].search(window, 1, end)
        return (m.start() - 1, m.end() - 1, sum(m.fuzzy_counts)) if m else None

    def places(self, i: int, clean: str, windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Matches (start, end, edits) in the windows, of those that overlap the one with fewer edits, then the first.

        A window whose best match overlaps a better one is searched again beside that one, and so is
        what an accepted match leaves of its window. Windows are short, so the work grows with their number.
        """
        phrase, _, k = self.notices[i]
        shortest, heap = len(phrase) - k, []
        taken: list[tuple[int, int, int]] = []

        def seek(a: int, b: int) -> None:
            if b - a >= shortest:
                found = self.best(i, (clean[a - 1] if a else " ") + clean[a:b] + (clean[b] if b < len(clean) else " "))
                if found:
                    heapq.heappush(heap, (found[2], a + found[0], a + found[1], a, b))

        for a, b in windows:
            seek(a, b)
        while heap:
            edits, start, end, a, b = heapq.heappop(heap)
            at = bisect.bisect_left(taken, (start,))
            near = [m for m in taken[max(at - 1, 0) : at + 2] if m[0] < end and start < m[1]]
            if not near:
                taken.insert(at, (start, end, edits))
                near = [(start, end, edits)]
            # A space stands before and behind a match.
            for (_, left, _), (right, _, _) in zip([(a, a, 0), *near], [*near, (b + 1, b, 0)]):
                seek(max(a, left), min(b, right - 1))
        return taken

    def hits(self, clean: str) -> list[Hit]:
        """All verified places of a normalised text, each notice's own places non-overlapping."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (length, uses) in self.seeds.iter(clean):
            begin = end - length + 1
            for i, at in uses:
                phrase, _, k = self.notices[i]
                a, b = max(0, begin - at - k - 1), min(len(clean), begin - at + len(phrase) + k + 1)
                spans.setdefault(i, []).append((a, b))
        if not spans:
            return []
        spaces = np.flatnonzero(np.frombuffer(clean.encode("utf-32-le"), "<u4") == 32)
        word = lambda at: int(np.searchsorted(spaces, at))
        out = []
        for i, windows in spans.items():
            phrase, label, k = self.notices[i]
            for start, end, edits in self.places(i, clean, _windows(windows, 2 * k)):
                first = word(start)
                out.append(Hit(label, first, word(end) - first + 1, start, end, edits, 1 - edits / len(phrase)))
        return sorted(out, key=lambda h: (h.start, h.end, h.label))


def source_spans(text: bytes, hits: list[Hit]) -> list[tuple[int, int]]:
    """Where hits stand in the text as it was given: code points, from their first word's start to their last word's end."""
    if not hits:
        return []
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    later = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)  # bytes that begin no code point
    first = np.array([h.first_word for h in hits])
    last = first + [h.n_words - 1 for h in hits]
    a, b = starts[first], ends[last]
    return list(zip((a - np.searchsorted(later, a)).tolist(), (b - np.searchsorted(later, b)).tolist()))


def base_places(clean: bytes) -> list[tuple[int, str]]:
    """(word, label) of all places where a base phrase's words stand consecutively."""
    padded, out, spaces = b" " + clean + b" ", [], None
    for phrase, label in BASE.items():
        want = b" " + phrase.encode() + b" "
        at = padded.find(want)
        while at >= 0:
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
            out.append((int(np.searchsorted(spaces, at)), label))
            at = padded.find(want, at + 1)
    return out


_SCHEMA = (
    "doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans string"
)


def _scan(notices: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            rows = []
            for value in batch.column("text").cast(pa.binary()):
                text = value.as_py() or b""
                clean = normalise(text)
                base = base_places(clean)
                hits = scanner.hits(clean.decode("utf-8", "replace"))
                at = [w for w, _ in base]
                labels = {x for _, x in base}
                rows.append((
                    clean.count(b" ") + 1 if clean else 0, len(base), min(at, default=None), max(at, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(labels | {h.label for h in hits})),
                    max([1.0] * bool(base) + [h.similarity for h in hits], default=0.0),
                    json.dumps([[h.label, *span, h.edits] for h, span in zip(hits, source_spans(text, hits))]),
                ))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", *names])

    return run


def scan_licenses(docs: DataFrame, notices: tuple = NOTICES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are maximal runs of digits, letters and non-ASCII characters after lower-casing A-Z. The
    n_base exact places give first_word, last_word (null without any) and base_labels; labels adds
    those of fuzzy matches, score is the best similarity (1 less edits over the notice's length; 0
    without a match), spans lists [label, start, end, edits] of the text as it was given, in code
    points, end exclusive. Null and empty texts have no words and no matches. Whole texts are searched, one row at a
    time, so the table's order and repeats don't matter; only doc_id and text are read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan(notices), _SCHEMA.format(kind=kind))

"""Quality rules as a ledger of bits.

Every rule is evaluated once. A document's ledger row holds what was measured and one bit for each rule
that it fails; a bit keeps its meaning for good, so ledgers of different days can be read together. A
policy is a version and a mask of bits: applying one, comparing two, or telling what each rule contributes
needs the ledger only, never the texts. An ablation counts documents by their masked bits, of which there
are at most two to the number of rules, and answers every question from these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window in which repeats are sought: a power of two.
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_DIGITS = b"0123456789"
_BULLETS = (b"-", b"*", b"\xe2\x80\xa2")
_ENDS = (b"...", b"\xe2\x80\xa6")

#: What is measured of a text, all counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered", "n_digits", "longest_word", "n_bullets", "n_cut_off")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # an expression over MEASURES, integers only


#: Bits are never given anew: a rule that changes its meaning gets another bit.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(5, "long_words", "word_chars > 12 * n_words"),
    Rule(6, "few_letters", "10 * n_lettered < 7 * n_words"),
    Rule(7, "digits", "4 * n_digits > word_chars"),
    Rule(8, "bullets", "10 * n_bullets > 9 * n_lines"),
    Rule(9, "cut_off_lines", "10 * n_cut_off > 3 * n_lines"),
    Rule(10, "endless_word", "longest_word > 1000"),
)
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Which rules drop a document, under a version."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


#: Policies only grow by new versions, so that a verdict can be made again from a ledger.
POLICIES = (
    Policy("1", BASE),
    Policy("2", (*BASE, "symbols", "repeated_lines", "few_letters", "digits")),
    Policy("3", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def _lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word: how many, equal to an earlier one, with a bullet, cut off."""
    seen, n, bullets, cut = set(), 0, 0, 0
    for line in text.split(b"\n"):
        bare = line.strip()
        if bare:
            seen.add(line)
            n += 1
            bullets += bare.startswith(_BULLETS)
            cut += bare.endswith(_ENDS)
    return n, n - len(seen), bullets, cut


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more.

    Windows of one, two, four and eight words are numbered in turn, so equal numbers are equal words.
    """
    if len(words) <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    width = 1
    while width < WINDOW:
        pairs = ids[:-width] * (len(words) + 1) + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
        if len(counts) == len(ids):
            return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8; null has no words."""
    text = text or b""
    words = text.split()
    spaced = np.frombuffer(text, np.uint8)
    letters = (spaced >= 128) | ((spaced | 32) >= 97) & ((spaced | 32) <= 122)
    white = (spaced == 32) | (spaced >= 9) & (spaced <= 13)
    # The number of the word that each byte belongs to; of the letters, how many different words they stand in.
    begins = ~white & np.concatenate(([True], white[:-1])) if len(text) else white
    lettered = len(np.unique(np.cumsum(begins)[letters]))
    n_lines, dup, bullets, cut = _lines(text)
    chars = int(np.count_nonzero((spaced & 0xC0) != 0x80)) - int(np.count_nonzero(white))
    without = lambda some: len(text) - len(text.translate(None, some))
    longest = max(words, key=len, default=b"")
    if len(longest) > 1000:  # the longest in code points may be another one than the longest in bytes
        longest_chars = max(len(w.decode("utf-8", "replace")) for w in words if len(w) > 1000)
    else:
        longest_chars = 0
    return len(words), chars, without(_SYMBOLS), dup, repeated_words(words), n_lines, lettered, without(_DIGITS), longest_chars, bullets, cut


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *MEASURES])


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, MEASURES, fail_bits.

    Words are runs without the six ASCII spaces; word_chars are their code points; n_symbols counts
    #*$%&|<>, n_dup_lines the lines with a word that equal an earlier one, n_repeat_words the words in
    windows of eight found twice or more. longest_word is told in code points from 1,001 bytes on, else
    it is 0. Null text has no words; a row's doc_id may be null or repeated. Texts are read whole, one
    at a time; an empty table gives an empty one. Only doc_id and text are read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_measured, schema)
    return rows.withColumn("fail_bits", fail_bits(rules))


def applied(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """A ledger with base_failed, kept and the policy's version; the texts aren't needed."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    base = Policy("", BASE).mask
    return rows.withColumn("base_failed", hit(base)).withColumn("kept", ~hit(policy.mask | base)).withColumn("policy", F.lit(policy.version))


def judge(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with a policy's verdict: ``ledger``'s columns, base_failed, kept, policy."""
    return applied(ledger(docs), policy)


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """ledger -> (policy, rule, n_docs, n_kept, n_failed, n_failed_alone, n_kept_without), a row for each rule of a policy.

    Rows are counted by fail_bits first: what goes on are at most as many counts as there are sets of
    rules, whatever the ledger's size. An empty ledger gives zeros.
    """
    session = rows.sparkSession
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits = {r.name: r.bit for r in RULES}
    wanted = session.createDataFrame([(p.version, p.mask, name, 1 << bits[name]) for p in policies for name in p.rules], "policy string, mask bigint, rule string, bit bigint")
    # A row for each rule and set of failures: both are bounded by the rules.
    each = wanted.join(counts, F.lit(True), "left")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule", "bit").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), total(failed == 0).alias("n_kept"),
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(failed == F.col("bit")).alias("n_failed_alone"),
        total(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    ).drop("bit")

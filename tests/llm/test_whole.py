"""Training-data operators on rows of which a part was left out."""

import random
import time

import pytest

from citemill.llm import license_scan, quotations


@pytest.mark.parametrize("label, places", [
    ("apache", ["apache licence", "apache license"]), ("gpl", ["gnu genral public license", "gnu general public license"]),
    ("apache", ["apache licence", "apachee license", "apache license", "apache licens", "apache license", "apache licence"]),
])
def test_weaker_places_beside_better_ones(label, places):
    text, want = "see", set()
    for p in places:
        want.add((len(text) + 1, len(text) + 1 + len(p)))
        text += " " + p
    hits = license_scan.Scanner().hits(text + " here")
    assert want <= {(h.start, h.end) for h in hits if h.label == label}


def test_places_are_whole_words_and_apart():
    text = " ".join(["apache licence", "apache license", "mit license"] * 2000)
    hits = [h for h in license_scan.Scanner().hits(text) if h.label == "apache"]
    assert [(h.start, h.end, h.edits) for h in hits] == [(42 * (i // 2) + 15 * (i % 2), 42 * (i // 2) + 15 * (i % 2) + 14, (i + 1) % 2) for i in range(4000)]


def edits_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_every_place_of_whole_words_is_found_or_overlaps_a_better_one():
    dice, scanner = random.Random(3), license_scan.Scanner()
    for _ in range(150):
        parts = []
        for phrase, _, k in dice.choices(license_scan.NOTICES, k=dice.randint(1, 5)):
            chars = list(phrase)
            for _ in range(dice.randint(0, k + 1)):
                at = dice.randrange(len(chars))
                chars[at : at + 1] = dice.choice([[], ["x"], [chars[at], "e"]])
            parts.append("".join(chars))
        text = " ".join(" ".join(parts).split())
        hits = scanner.hits(text)
        starts = [i for i in range(len(text)) if not i or text[i - 1] == " "]
        ends = [i for i in range(1, len(text) + 1) if i == len(text) or text[i] == " "]
        for phrase, label, k in license_scan.NOTICES:
            own = [h for h in hits if h.label == label and len(phrase) * (1 - h.similarity) == pytest.approx(h.edits)]
            for a in starts:
                for b in ends:
                    if len(phrase) - k <= b - a <= len(phrase) + k and (edits := edits_by_hand(phrase, text[a:b])) <= k:
                        assert any(h.start < b and a < h.end and h.edits <= edits for h in own), (text, phrase, text[a:b])
        for h in hits:
            assert (not h.start or text[h.start - 1] == " ") and (h.end == len(text) or text[h.end] == " ")
            assert any(label == h.label and edits_by_hand(p, text[h.start : h.end]) == h.edits <= k for p, label, k in license_scan.NOTICES)


@pytest.mark.parametrize("unit", ["gnu general publik license ", "apache licence ", "permission is herby granted free of charge "])
def test_repeated_edited_notices_take_linear_time(unit):
    n = 2_000_000 // len(unit)
    t = time.perf_counter()
    hits = license_scan.Scanner().hits((unit * n).strip())
    assert time.perf_counter() - t < 20 and len([h for h in hits if h.start % len(unit) == 0]) >= n


def links(spark, *messages):
    rows = quotations.link_quotations(spark.createDataFrame([(c, t, "user", x) for c, t, x in messages], "conv_id bigint, turn bigint, role string, text string")).collect()
    return {(r.conv_id, r.turn): ((r.parent_conv, r.parent_turn), (r.thread_conv, r.thread_turn), r.depth) for r in rows}


def test_short_quotations_within_a_conversation(spark):
    got = links(spark, (1, 0, "Why?"), (1, 1, "> Why?\nSo it is"), (1, 2, "> x\nno"), (2, 0, "> Why?\nElsewhere"))
    assert got == {(1, 0): ((None, None), (1, 0), 0), (1, 1): ((1, 0), (1, 0), 1), (1, 2): ((None, None), (1, 2), 0), (2, 0): ((None, None), (2, 0), 0)}


def test_originals_in_conversations_of_larger_id(spark):
    got = links(spark, (1, 0, "> stands only in seven\nindeed"), (7, 0, "Stands only in seven"), (2, 0, "> stands only in seven\nstands only in seven"), (7, 1, "> indeed"))
    assert got[1, 0] == ((2, 0), (7, 0), 2) and got[2, 0] == ((7, 0), (7, 0), 1) and got[7, 0] == ((None, None), (7, 0), 0)


def test_cycles_have_one_root(spark):
    n = 11
    ring = [(c, 0, f"> passage number {(c + 1) % n} here\npassage number {c} here") for c in range(n)]
    tails = [(100, 0, "> passage number 5 here\na tail of it"), (101, 0, "> a tail of it\nand its end"), (-5, 0, "> and its end")]
    got = links(spark, *ring, *tails, (200, 0, "one of two messages\n> two of two messages"), (201, 0, "two of two messages\n> one of two messages"))
    assert all(got[c, 0] == (((c + 1) % n, 0), (0, 0), (n - c) % n) for c in range(n))
    assert got[100, 0] == ((5, 0), (0, 0), 7) and got[101, 0] == ((100, 0), (0, 0), 8) and got[-5, 0] == ((101, 0), (0, 0), 9)
    assert got[200, 0] == ((201, 0), (200, 0), 0) and got[201, 0] == ((200, 0), (200, 0), 1)

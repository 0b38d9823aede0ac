"""Rule ledger and Merkle manifest: by hand, on odd rows, over several blocks and heights."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from citemill.llm import manifest, quality

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, `node` string, row int, g map<string,string>"


def odd_rows(spark):
    rows = [
        (5, "One Text", "en", "a", 8), (5, "One Text", "en", "a", 8), (5, "another", "en", None, None), (None, "no id", "en", "b", 1), (None, None, None, None, None),
        (6, "", "en", "", 0), (7, "ÄÖ É", None, "é:2", -4), (8, "UPPER", "", "x", 3), (12, None, "fr", "x", 3), (13, "A" * 100_000, "fr", "x", 3),
    ]
    return spark.createDataFrame([(*r, "n", 1, {"a": "b"}) for r in rows], ODD)


# ---- quality ----


def by_hand(text):
    words, white = [], " \t\n\v\f\r"
    for c in text or "":
        if c in white:
            words.append("")
        elif not words:
            words.append(c)
        else:
            words[-1] += c
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(white)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_measures_by_hand():
    dice = random.Random(2)
    texts = [None, "", " \n\n", "a", "a " * 8, "a " * 9, "x y\nx y\n x y\nx y\r\n\n", "# é < ü  > ０ b", "α" * 600 + " b"]
    texts += ["".join(dice.choices(["a ", "b ", "c\n", "# ", "é", "\t", "d e f g h i j k "], k=dice.randint(1, 120))) for _ in range(300)]
    for text in texts:
        assert quality.measure(text.encode() if text is not None else None)[:5] == by_hand(text), text


def test_longest_word_and_lettered():
    n = dict(zip(quality.MEASURES, quality.measure(("é" * 900 + " " + "x" * 1200 + " 12 3a").encode())))
    assert n["longest_word"] == 1200 and n["n_lettered"] == 3 and n["n_digits"] == 3


def test_a_text_of_megabytes_takes_seconds():
    import time

    text = ("every word here stands again and again # " * 120_000).encode()
    t = time.perf_counter()
    n = dict(zip(quality.MEASURES, quality.measure(text)))
    assert time.perf_counter() - t < 15 and n["n_repeat_words"] == n["n_words"] == 960_000


def test_ledger_of_odd_rows_and_empty_tables(spark):
    rows = quality.judge(odd_rows(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["5", "5", "5", "None", "None", "6", "7", "8", "12", "13"])
    assert all(r.base_failed and not r.kept and r.fail_bits & 1 for r in rows)
    empty = odd_rows(spark).where("false")
    assert quality.judge(empty).collect() == []
    assert {tuple(r)[2:] for r in quality.ablation(quality.ledger(empty)).collect()} == {(0, 0, 0, 0, 0)}


def test_policies_and_ablation_against_loops(spark):
    dice = random.Random(5)
    bits = [dice.choice([0, 0, 1 << dice.randrange(11), dice.randrange(2048)]) for _ in range(3000)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bits)], "doc_id bigint, fail_bits bigint")
    for policy in quality.POLICIES:
        kept = {r.doc_id for r in quality.applied(rows, policy).where("kept").collect()}
        assert kept == {i for i, b in enumerate(bits) if not b & policy.mask}
    for r in quality.ablation(rows).collect():
        mask = next(p.mask for p in quality.POLICIES if p.version == r.policy)
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert tuple(r)[2:] == (
            3000, sum(not b & mask for b in bits), sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(not b & mask & ~bit for b in bits)
        )


def test_verdicts_follow_from_base_and_policy(spark):
    words = ["w" + "abcdefgh"[i % 8] * (1 + i // 8) for i in range(40)]
    texts = [" ".join(words), " ".join(words[:19]), " ".join(words[:8] * 5), " ".join(words) + " #" * 9, " ".join(map(str, range(1000, 1060)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False)}
    assert {r.doc_id for r in quality.judge(df, quality.POLICIES[0]).where("kept").collect()} == {0, 3, 4}


# ---- manifest ----


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([digest("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    return levels


def beside(levels, i):
    for now in levels[:-1]:
        a = i // 8 * 8
        yield "".join(now[a:i]), "".join(now[i + 1 : a + 8])
        i //= 8


def manifest_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, **new: digest("".join(field(new.get(c, r[c])) for c in manifest.FIELDS))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: grow([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order}
    top = grow([trees[k][-1][0] for k in order])
    out = []
    for n, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            sides = [*beside(trees[k], i), *beside(top, n)]
            node = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                node = leaf(r, text="".join(c.lower() if c.isascii() else c for c in r["text"]))
            for a, b in sides:
                node = digest(a + node + b)
            out.append((str(r["doc_id"]), own, trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in sides)), node, node == top[-1][0]))
    return sorted(out)


def made(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in manifest.manifest(df).collect())


def test_manifest_of_odd_rows(spark):
    df = odd_rows(spark)
    assert made(df) == manifest_by_hand([r.asDict() for r in df.collect()])
    assert manifest.manifest(df.where("false")).collect() == [] and manifest.head(df.where("false")).collect() == []


@pytest.mark.parametrize("sizes", [[1], [512, 1], [8, 64, 65, 513, 1025, 1, 1, 1, 1]])
def test_manifest_at_edges_of_runs_and_blocks(spark, sizes):
    rows = [(1000 * g + i, f"Text {i}" if i % 3 else f"text {i}", f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert made(df) == manifest_by_hand([r.asDict() for r in df.collect()])


def test_manifest_of_three_heights(spark, monkeypatch):
    """Blocks of 64 nodes: 4,100 leaves of one language are three heights of blocks; 70 languages are two."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(manifest, "BLOCK", 64)
    rows = [(i, f"T{i}", "big", "s", i) for i in range(4100)] + [(10_000 + i, f"T{i}", f"k{i}", "s", i) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    want = manifest_by_hand([r.asDict() for r in df.collect()])
    assert made(df) == want and manifest.head(df).first().root == want[0][3]


def test_any_change_changes_the_root(spark):
    df = spark.createDataFrame([(i, f"t{i}", None, "s", 1) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    roots = {manifest.head(x).first().root for x in (df, df.where("doc_id <> 7"), df.withColumn("source", F.lit("S")), df.withColumn("text", F.when(F.col("doc_id") != 3, F.col("text"))), df.withColumn("lang", F.lit("")))}
    assert len(roots) == 5

"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Every
distinct fingerprint emits itself and all fingerprints at one bit's distance (half of the radius);
two fingerprints at two bits or less emit a common one and meet there. A meeting place holds 65
fingerprints at most, so none can grow hot, and linking each to the least of them keeps every
connection without emitting all pairs.

Near copies of a similarity of five-word shingles are further apart than two bits of 64. For them
``keep_one_of_each_group`` takes several shorter fingerprints of a text's different words, which an
edit moves little; what meets in any of them is verified on the whole shingle sets. Bits that an edit
turns are those of which the majority was narrow, so beside the ball each of these fingerprints also
emits the variants with two of its least certain bits turned.

What meets is linked along stars, and an exact search follows for the similar texts that these leave
apart: two sets of a similarity of 0.8 share one of the rarest fifth of each one's shingles (prefix
filtering), so texts of different groups that do are verified, too. Where many texts share a shingle, they are
told apart by what they differ in from one of them: similar sets have most of that in common (``_differing``). No link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, stored, swept
from .components import components

SHINGLE_WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ; each side covers half of them.
RADIUS = 2
#: Shingles whose bits are held at once.
AT_ONCE = 1 << 16
#: Near copies have at least this Jaccard similarity of their sets of NEAR_WORDS-word shingles.
NEAR_SIMILARITY, NEAR_WORDS = 0.8, 5
#: Fingerprints by which near copies are sought, and bits of each: 192 bits of a word's hashes in all.
TABLES, TABLE_BITS = 4, 48
#: Least certain bits of such a fingerprint, of which variants turn two at a time.
UNSURE = 6
#: Texts whose words are told apart at once.
TEXTS_AT_ONCE = 256
#: Texts, about, of which shingles are counted to tell rare ones from frequent ones, and frequent ones that are
#: kept. Any order of shingles gives the same links; one by frequency gives few pairs to verify.
COUNTED_TEXTS, FREQUENT = 1 << 14, 1 << 16
#: Words of 64 bits of a set's parities, which bound the similarity of two sets from above.
PARITY_WORDS = 16
#: Texts to verify, up to which their digests go to the texts; the texts of more are shuffled.
SENT_DIGESTS = 1 << 16
#: Rounds of star links over shared shingles, before all pairs of what they leave apart.
STAR_ROUNDS = 3
#: Texts of a shingle up to which all their pairs are looked at; of more, pairs are sought by differences from a pivot.
PAIRED_TEXTS = 16
#: Texts of a pivot, by whose differences frequent ones are told.
TOLD_MEMBERS = 6
#: Parts, by their shingles, in which the rarest shingles of all texts are dealt out: shuffle files of one part are there at a time.
SHINGLE_PARTS = 4
#: Two sets of a similarity of NEAR_SIMILARITY differ in this part of their sizes' sum at most.
APART = (1 - NEAR_SIMILARITY) / (1 + NEAR_SIMILARITY)


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of a text. Words end at the six ASCII white-space bytes; no words: 0."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - shingle_words + 1)
    ends = starts[min(shingle_words, len(words)) :][:n] - 1
    ones = np.zeros(64, np.int64)
    for a in range(0, n, AT_ONCE):
        some = zip(starts[a : min(a + AT_ONCE, n)].tolist(), ends[a : a + AT_ONCE].tolist())
        hashed = np.array([xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in some], np.uint64)
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = ones * 2 > n
    return int(np.packbits(majority, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], prints], [*kept, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row's whole text; only these two columns are read."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> (hi, lo): verified links within RADIUS bits that connect what all links connect."""
    ball = F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    met = distinct.select("fp", F.explode(ball).alias("variant"))
    least = met.withColumn("lo", F.min("fp").over(Window.partitionBy("variant")))
    pairs = least.where("fp > lo").select(F.col("fp").alias("hi"), "lo").distinct()
    return pairs.where(F.bit_count(F.col("hi").bitwiseXOR(F.col("lo"))) <= RADIUS)


def _rooted(nodes: DataFrame) -> DataFrame:
    """nodes(fp, ...) -> with root: the least fingerprint reachable."""
    roots = components(links(nodes.select("fp")))
    return nodes.join(roots, nodes.fp == roots.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable by links, itself included. Null text counts as
    empty; texts without words share fingerprint zero and link like any other. Equal fingerprints
    are one node, so thousands of copies add no links. Null doc_ids never become a component_id
    unless the whole component has none. An empty table gives an empty one.
    """
    prints = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    placed = _rooted(nodes)
    named = placed.join(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    return prints.join(named.select("fp", "component_id"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word codes of all texts, where each text's begin and the last one's end, the word of each code)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = split.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    if b"" in words:  # what the splitter sees around white space at a text's ends
        real = codes != words.index(b"")
        codes, text = codes[real], text[real]
    return codes, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]), words


def table_prints(texts: pa.Array) -> np.ndarray:
    """(texts, 2 * TABLES): fingerprints of the texts' different words, the table's number above their bits;
    then for each of them the positions of its UNSURE least certain bits, six bits a position.
    """
    codes, offsets, words = _coded(texts)
    hashed = b"".join([xxhash.xxh3_128_digest(w, SEED) + xxhash.xxh64_digest(w, SEED) for w in words])
    bits = np.frombuffer(hashed, np.uint8).reshape(-1, TABLES * TABLE_BITS // 8)
    lead = np.zeros((len(texts), TABLES * TABLE_BITS), np.int64)  # by how many words ones lead
    for at in range(len(texts)):
        own = np.unique(codes[offsets[at] : offsets[at + 1]])
        for a in range(0, len(own), AT_ONCE):
            lead[at] += 2 * np.unpackbits(bits[own[a : a + AT_ONCE]], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        lead[at] -= len(own)
    lead = lead.reshape(len(texts), TABLES, TABLE_BITS)
    wide = np.zeros((len(texts), TABLES, 8), np.uint8)
    wide[:, :, : TABLE_BITS // 8] = np.packbits(lead > 0, axis=2, bitorder="little")
    places = wide.view("<i8")[:, :, 0] + (np.arange(TABLES) << TABLE_BITS)
    unsure = np.argsort(np.abs(lead), axis=2, kind="stable")[:, :, :UNSURE] << (6 * np.arange(UNSURE))
    return np.concatenate([places, unsure.sum(axis=2)], axis=1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's set of NEAR_WORDS-word shingles as 64-bit hashes; fewer words are one shingle, none give none."""
    codes, offsets, words = _coded(texts)
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    sets = []
    for at in range(len(texts)):
        own = hashes[codes[offsets[at] : offsets[at + 1]]]
        n = len(own) and max(1, len(own) - NEAR_WORDS + 1)
        mixed = np.full(n, min(len(own), NEAR_WORDS), np.uint64)
        for i in range(min(len(own), NEAR_WORDS)):
            mixed = (mixed ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        sets.append(np.unique(mixed).view(np.int64))
    return sets


def _lists(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if len(rows) else [], pa.int64()))


def _listing(**of_texts: Callable) -> Callable:
    """Batches with ``text`` replaced by the lists of numbers that each of ``of_texts`` makes of it, under its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(a, TEXTS_AT_ONCE)
                kept = [c for c in batch.schema.names if c != "text"]
                made = [_lists(lists(batch.column("text"))) for lists in of_texts.values()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, *of_texts])

    return run


def _meetings(places: DataFrame) -> DataFrame:
    """places(place, unsure), places distinct -> (hi, lo): places of one table that meet at a variant.

    Variants are the ball of half the radius, and those with two of the UNSURE bits turned. A variant
    meets places within two bits of it, 1,177 at most; each is linked to the least and to the one before it.
    What this leaves apart, ``unmet`` finds.
    """
    place = F.col("place")
    at = [F.shiftright("unsure", 6 * k).bitwiseAND(63).cast("int") for k in range(UNSURE)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), p) for p in at]
    both = [place.bitwiseXOR(a).bitwiseXOR(b) for a, b in combinations(bits, 2)]
    ball = F.array(place, *[place.bitwiseXOR(F.lit(1 << i)) for i in range(TABLE_BITS)], *both)
    met = places.select("place", F.explode(ball).alias("variant"))
    order = Window.partitionBy("variant").orderBy("place")
    seen = met.select("place", F.array(F.first("place").over(order), F.lag("place").over(order)).alias("others"))
    return seen.select(F.col("place").alias("hi"), F.explode("others").alias("lo")).where("lo < hi").distinct()


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes(node, prints) -> (hi, lo), hi > lo: pairs to verify.

    A place's nodes are each paired with its least one, its head; heads of places that meet are paired. Tables are
    taken one after another, since places of different ones never meet.
    """
    told = [F.struct(F.col("prints")[t].alias("place"), F.col("prints")[TABLES + t].alias("unsure")) for t in range(TABLES)]
    placed = nodes.select("node", F.inline(F.array(*told)))
    heads = placed.groupBy("place").agg(F.min("node").alias("head"), F.min_by("unsure", "node").alias("unsure"))
    heads = materialise(heads, "places")
    inside = placed.join(heads.select("place", "head"), "place").where("node > head").select(F.col("node").alias("hi"), F.col("head").alias("lo"))
    of_hi, of_lo = (heads.select(F.col("place").alias(c), F.col("head").alias(f"{c}_head")) for c in ("hi", "lo"))
    met = [materialise(_meetings(heads.where(F.shiftright("place", TABLE_BITS) == t)), "meetings") for t in range(TABLES)]
    met = reduce(DataFrame.union, met).join(of_hi, "hi").join(of_lo, "lo").where("hi_head <> lo_head")
    return inside.union(met.select(F.greatest("hi_head", "lo_head"), F.least("hi_head", "lo_head"))).distinct()


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """texts(text) -> (shingles that a sample of about COUNTED_TEXTS of them repeats, ascending; in how many of it each is)."""
    part = max(1, texts.count() // COUNTED_TEXTS)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    counts = sample.mapInArrow(_listing(shingles=shingle_sets), "shingles array<bigint>").select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    with swept(texts.sparkSession):
        told = counts.where("count > 1").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow().sort_by("shingle")
    return told["shingle"].to_numpy(), told["count"].to_numpy()


def rarest(shingles: np.ndarray, counts: np.ndarray) -> Callable:
    """Of texts: the size of each one's shingle set and the parities of its shingles by their top bits, PARITY_WORDS
    numbers; then its rarest shingles, by count and value: so many that a set of a similarity of NEAR_SIMILARITY or
    more shares one of them. A text without words has size 0 and a shingle 0.
    """
    bits = 64 * PARITY_WORDS

    def of_texts(texts: pa.Array) -> list[np.ndarray]:
        rows = []
        for own in shingle_sets(texts):
            most = len(own) - math.ceil(NEAR_SIMILARITY * len(own) - 1e-9) + 1
            at = np.searchsorted(shingles, own)
            known = at < len(shingles)
            known[known] = shingles[at[known]] == own[known]
            count = np.zeros(len(own), np.int64)
            count[known] = counts[at[known]]
            rare = own[np.lexsort((own, count))[:most]] if len(own) else np.zeros(1, np.int64)
            odd = np.bincount((own.view(np.uint64) >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
            rows.append(np.concatenate([[len(own)], np.packbits(odd.astype(np.uint8)).view(np.int64), rare]))
        return rows

    return of_texts


def _shared(rows: DataFrame) -> DataFrame:
    """rows(shingle, node, root, size, pos) -> those of shingles under several roots, with the most common of these.

    Shingles of the same texts become one, which stands where a text's first of them does: a pair met at each of
    them before. Should hashes of two sets of texts be equal, their texts meet as well; none are parted.
    """
    same, every = Window.partitionBy("shingle", "root"), Window.partitionBy("shingle")
    common = F.max_by("root", F.struct("own", -F.col("root"))).over(every).alias("common")
    # Dealt out by shingle, rows lie well for both windows.
    counted = rows.repartition("shingle").withColumn("own", F.count("*").over(same))
    counted = counted.select("*", F.count("*").over(every).alias("n"), common, F.bit_xor(F.xxhash64("node")).over(every).alias("texts"))
    return _once(counted.where("own < n").drop("shingle").withColumnRenamed("texts", "shingle"))


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shingle", "common", "node", "root", "size").agg(F.min("pos").alias("pos"))


def _shared_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``_shared`` of the rarest shingles of all nodes(node, rare), a part of the shingles after another.

    Nearly all shingles are one text's; they go where the rows of a shingle first meet, before roots are looked up.
    """
    head = 1 + PARITY_WORDS
    rare = F.posexplode(F.slice("rare", F.lit(1 + head), F.size("rare") - head)).alias("pos", "shingle")
    rows, found = nodes.select("node", F.col("rare")[0].cast("int").alias("size"), rare), []
    for part in range(SHINGLE_PARTS):
        own = rows.where(F.pmod("shingle", F.lit(SHINGLE_PARTS)) == part)
        met = own.withColumn("n", F.count("*").over(Window.partitionBy("shingle"))).where("n > 1").drop("n")
        rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found.append(materialise(_shared(rooted), "shared-part"))
    shared = materialise(_once(reduce(DataFrame.union, found)), "shared-shingles")
    for part in found:
        discard(part)
    return shared


def _fitting(met: DataFrame) -> DataFrame:
    """met(a, b), rows of one shingle -> (hi, lo, hi_root, lo_root): pairs of different roots that may be similar from there on."""
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    after = F.least(F.expr("a.size - a.pos"), F.expr("b.size - b.pos"))
    fit = met.where("a.root <> b.root").where((small + 1e-6 >= NEAR_SIMILARITY * large) & (after + 1e-6 >= NEAR_SIMILARITY / (1 + NEAR_SIMILARITY) * (small + large)))
    return fit.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).selectExpr("hi.node as hi", "lo.node as lo", "hi.root as hi_root", "lo.root as lo_root").distinct()


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Each row with the one before it by root, and with the least under its shingle's most common root."""
    row, every = F.struct("node", "root", "size", "pos"), Window.partitionBy("shingle")
    before = F.lag(row).over(every.orderBy("root", "node"))
    least = F.min(F.when(F.col("root") == F.col("common"), row)).over(every)
    return _fitting(shared.select(row.alias("a"), F.array(before, least).alias("others")).select("a", F.explode("others").alias("b")))


def _all_pairs(shared: DataFrame) -> DataFrame:
    """All pairs under different roots; rows under the most common root are never paired with each other."""
    row = F.struct("node", "root", "size", "pos")
    others = shared.where("root <> common").select("shingle", "common", row.alias("a"))
    met = others.join(shared.select("shingle", "common", row.alias("b")), ["shingle", "common"])
    return _fitting(met.where("a.root <> b.root and (b.root = common or a.node > b.node)"))


def _by_number(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of shingles of up to PAIRED_TEXTS texts, and those of more."""
    n = F.count("*").over(Window.partitionBy("shingle", "common"))
    counted = shared.withColumn("n", n)
    return counted.where(F.col("n") <= PAIRED_TEXTS).drop("n"), counted.where(F.col("n") > PAIRED_TEXTS).drop("n")


def _by_size(shared: DataFrame) -> DataFrame:
    """Rows of common shingles, parted by bands of sizes: two that fit are in one band or in neighbouring ones."""
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1 / NEAR_SIMILARITY + 1e-4))
    banded = shared.withColumn("band", F.explode(F.array(band, band + 1)))
    return _shared(banded.select(F.xxhash64("shingle", "common", "band").alias("shingle"), "node", "root", "size", "pos"))


def _differing(shared: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of shingles of many texts -> (hi, lo, hi_root, lo_root): pairs of different roots that may be similar.

    A pivot is any one text of a shingle. With D(x) for the shingles in which x and the pivot differ, x and y differ in
    |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and in APART of their sizes' sum at most if they are similar. So by
    e(x) = |D(x)| - APART * |x| they need (e(x) + e(y)) / 2 differences in common. If that is 0 or less, x and y are
    similar, and both are so to the text of the least e, to which such texts are linked. Else they meet at one of
    the rarest of their differences, of which they leave out fewer than they need in common. Thus edited
    copies of one text, far apart from each other by edits of their own, meet seldom, however many there are.
    """
    pivot = F.min(F.when(F.col("root") == F.col("common"), F.col("node"))).over(Window.partitionBy("shingle", "common"))
    members = materialise(shared.select(pivot.alias("pivot"), "node", "root", "size").distinct(), "members")
    sets = sets_of(members.select("node").distinct())
    of_pivot = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_set"))
    both = members.join(sets, "node").join(of_pivot, "pivot")
    diff = F.concat(F.sort_array(F.array_except("shingles", "pivot_set")), F.sort_array(F.array_except("pivot_set", "shingles")))
    told = both.select("pivot", "node", "root", "size", diff.alias("diff")).withColumn("e", F.size("diff") - APART * F.col("size"))
    told = materialise(told, "differences")
    discard(sets)

    row = F.struct("e", "node", "root")
    least = told.groupBy("pivot").agg(F.min(row).alias("first"), F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("common"))
    second = told.join(least, "pivot").where("root <> first.root").groupBy("pivot").agg(F.min("e").alias("second"))
    least = materialise(least.join(second, "pivot"), "least-differences")
    seen = told.join(least, "pivot")
    sure = seen.where((F.col("root") != F.col("first.root")) & (F.col("e") + F.col("first.e") <= 1e-6))
    sure = sure.select(F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("first.node").alias("b"), F.col("first.root").alias("b_root"))

    # Of a text's differences, rarest first, as many as leave fewer than any text of another root would need.
    other = F.when(F.col("root") == F.col("first.root"), F.col("second")).otherwise(F.col("first.e"))
    need = F.greatest((F.col("e") + other) / 2, F.col("e") - APART / NEAR_SIMILARITY * F.col("size"), F.lit(0.0))
    # Its own edits stand before what it lacks of the pivot, frequent ones, told by a few members, last; any order of a pivot's
    # differences gives the same links.
    nth = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("node")))
    some = told.withColumn("nth", nth).where(F.col("nth") <= TOLD_MEMBERS).select("pivot", F.explode("diff").alias("item"))
    often = some.groupBy("pivot", "item").count().where("count > 1").groupBy("pivot").agg(F.collect_set("item").alias("often"))
    seen = seen.join(often, "pivot", "left").withColumn("often", F.coalesce("often", F.array().cast("array<bigint>")))
    ordered = F.concat(F.array_except("diff", "often"), F.array_intersect("diff", "often"))  # both keep the order
    listed = seen.select("pivot", "common", "node", "root", "size", "e", F.size("diff").alias("n"), need.alias("need"), ordered.alias("ordered"))
    first = F.greatest(F.floor(F.col("n") - F.col("need") + 1e-6) + 1, F.lit(0)).cast("int")
    listed = listed.select("pivot", "common", "node", "root", "size", "e", "n", F.posexplode(F.slice("ordered", F.lit(1), first)).alias("pos", "item"))
    listed = listed.withColumn("times", F.count("*").over(Window.partitionBy("pivot", "item"))).where("times > 1")
    listed = materialise(listed.select("pivot", "item", "common", F.struct("node", "root", "size", "e", (F.col("n") - F.col("pos")).alias("after")).alias("a")), "listed-differences")
    met = listed.where("a.root <> common").join(listed.select("pivot", "item", F.col("a").alias("b")), ["pivot", "item"])
    met = met.where("a.root <> b.root and (b.root = common or a.node > b.node)")
    small, large, both_e = F.least("a.size", "b.size"), F.greatest("a.size", "b.size"), F.expr("a.e + b.e")
    met = met.where((small + 1e-6 >= NEAR_SIMILARITY * large) & (both_e > 0) & (F.least("a.after", "b.after") + 1e-6 >= both_e / 2))
    pairs = sure.union(met.selectExpr("a.node", "a.root", "b.node", "b.root"))
    hi_first = F.col("a") > F.col("b")
    pairs = pairs.select(*[F.when(hi_first, x).otherwise(y).alias(c) for c, x, y in (("hi", F.col("a"), F.col("b")), ("lo", F.col("b"), F.col("a")), ("hi_root", F.col("a_root"), F.col("b_root")), ("lo_root", F.col("b_root"), F.col("a_root")))])
    return pairs.distinct()


def _last_pairs(shared: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All pairs that may be similar of what star links leave apart: a shingle's few texts are paired, many by their differences."""
    few, many = _by_number(shared)
    pairs, many = _all_pairs(few), materialise(_by_size(many), "common-shingles")
    if many.isEmpty():
        return pairs
    # Pairs are united, not rows before the join: Spark 4.1 may take a union for partitioned as its parts are.
    fewer, rest = _by_number(many)
    return pairs.union(_all_pairs(fewer)).union(_differing(rest, sets_of)).distinct()


def unmet(nodes: DataFrame, roots: DataFrame, similar: Callable[[DataFrame], DataFrame], sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes(node, rare), roots(node, root) -> (node, root): which roots are one, as all similar texts under different roots tell.

    Two similar sets share one of the rarest shingles of both, and from the first such on as many as their sizes demand.
    Star links first make large groups one, so that all pairs need to be looked at between what is left only.
    """
    shared = _shared_of(nodes, roots)
    rounds, found = STAR_ROUNDS, []
    while True:
        links = similar(_star_pairs(shared) if rounds else _last_pairs(shared, sets_of))
        some = not links.isEmpty()
        if some:
            found.append(links.select(F.greatest("hi_root", "lo_root").alias("hi"), F.least("hi_root", "lo_root").alias("lo")))
        if not rounds:
            break
        if some:
            tops = components(found[-1]).toDF("root", "top")
            before, shared = shared, shared.drop("common").join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
            shared = materialise(_shared(shared), "shared-shingles")
            discard(before)
        rounds = rounds - 1 if some else 0
    return components(reduce(DataFrame.union, found, links.select("hi", "lo").limit(0)))


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(hi, lo, ...) that may be similar by nodes(node, rare): sizes and parities alone.

    Sets that differ in few shingles differ in no more parities; similar ones differ in a ninth of their sizes' sum at most.
    """
    told = nodes.select("node", F.slice("rare", 1, 1 + PARITY_WORDS).alias("told"))
    of_hi, of_lo = (told.select(F.col("node").alias(c), F.col("told").alias(f"{c}_told")) for c in ("hi", "lo"))
    both = pairs.join(of_hi, "hi").join(of_lo, "lo")
    odd = sum((F.bit_count(F.col("hi_told")[i].bitwiseXOR(F.col("lo_told")[i])) for i in range(1, 1 + PARITY_WORDS)), F.lit(0))
    sizes = F.col("hi_told")[0] + F.col("lo_told")[0]
    return both.where(odd <= APART * sizes + 1e-6).select(*pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(hi, lo, ...) whose sets(node, shingles) have a similarity of NEAR_SIMILARITY or more; two empty sets are equal."""
    of_hi, of_lo = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("hi", "lo"))
    both = pairs.join(of_hi, "hi").join(of_lo, "lo").withColumn("sizes", F.size("hi_set") + F.size("lo_set"))
    shared = F.size(F.array_intersect("hi_set", "lo_set"))
    return both.where(shared + 1e-9 >= NEAR_SIMILARITY * (F.col("sizes") - shared)).select(*pairs.columns)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of each group of near copies the row with the smallest doc_id.

    Two texts are linked if their sets of five-word shingles (A-Z lower-cased, words parted by ASCII white
    space) have a similarity of 0.8 or more; groups are what links connect. Links are sought where texts
    meet at a variant of one of TABLES fingerprints first, then among the groups found by ``unmet``, so all
    count. Texts without words, null ones included, are linked.

    A null doc_id counts as larger than any; of rows that share the smallest doc_id, that with the
    least digest of its text stays, so exactly one row of each group does, whatever the ids are.
    Of rows equal in doc_id and text, one stays. An empty table gives an empty one.
    """
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text"), digest.alias("digest"))
    stays = stored(lambda: _stays(marked), docs.sparkSession, "stays")
    # Rows equal in doc_id and text go before the shuffle, and the text moves once: window and join share the key.
    others = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and t != "variant"]
    first = Window.partitionBy("key").orderBy(F.xxhash64(*[F.col(f"row.`{c}`") for c in others]) if others else F.lit(0))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", digest.alias("digest")).alias("key"))
    once = keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return once.join(stays, "key", "left_semi").select("row.*")


def _stays(marked: DataFrame) -> DataFrame:
    """marked(doc_id, text, digest) -> (key: doc_id and digest) of the row that stays of each group."""
    kind = dict(marked.dtypes)["doc_id"]
    told = _listing(prints=table_prints, rare=rarest(*frequent_shingles(marked.select("text"))))
    prints = marked.mapInArrow(told, f"doc_id {kind}, digest binary, prints array<bigint>, rare array<bigint>")
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes = prints.groupBy("digest").agg(F.min(least).alias("least"), F.first("prints").alias("prints"), F.first("rare").alias("rare"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets_of(asked: DataFrame) -> DataFrame:
        asked = materialise(asked.join(nodes.select("node", "digest"), "node"), "asked")
        nth = F.row_number().over(Window.partitionBy("digest").orderBy(F.lit(0)))
        few = F.broadcast(asked) if asked.count() <= SENT_DIGESTS else asked
        texts = marked.select("digest", "text").join(few, "digest").withColumn("nth", nth).where("nth = 1").select("node", "text")
        sets = materialise(texts.mapInArrow(_listing(shingles=shingle_sets), "node bigint, shingles array<bigint>"), "shingles")
        discard(asked)
        return sets

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = materialise(possible(pairs, nodes), "pairs")
        sets = sets_of(pairs.select(F.explode(F.array("hi", "lo")).alias("node")).distinct())
        links = materialise(verified(pairs, sets), "links")
        discard(pairs)
        discard(sets)
        return links

    roots = components(similar(candidates(nodes)))
    tops = unmet(nodes, roots, similar, sets_of).toDF("root", "top")

    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(tops, "root", "left")
    rooted = rooted.groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("least").alias("least"))
    return rooted.select(F.struct("least.doc_id", "least.digest").alias("key"))

"""Evidence: which texts hold a quote, what a token budget reaches, and audits of a manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from citemill.functions.text import match_text
from citemill.sources.store import stored

#: Characters of quotes in one automaton.
QUOTE_CHARS = 1 << 20


def resolve(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quotes(qid, pos, doc_id, quote), chunks(chunk_id, doc_id, text) -> (qid, pos, chunk_ids): sorted, empty if none.

    A chunk of the quote's document holds the quote if its normalised text contains it.
    """
    held = chunks.select("chunk_id", F.col("doc_id").alias("d"), match_text(F.col("text")).alias("body"))
    asked = quotes.select("qid", "pos", "doc_id", match_text(F.col("quote")).alias("q"))
    joined = asked.join(held, (F.col("doc_id") == F.col("d")) & F.contains("body", "q"), "left")
    return joined.groupBy("qid", "pos").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def gold_groups(resolved: DataFrame) -> DataFrame:
    """(qid, gold_groups): the chunk ids of each quote, in the quotes' order."""
    return resolved.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_ids"))), lambda x: x["chunk_ids"]).alias("gold_groups"))


def unresolved(groups: DataFrame) -> DataFrame:
    """The questions of which a quote is nowhere."""
    return groups.where(F.exists("gold_groups", lambda g: F.size(g) == 0))


def locate(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes(qid, quote), texts(id, text) -> (qid, id): texts whose normalised form contains the quote, wherever it is.

    Quotes are a stated set: they go to the executors as automata of QUOTE_CHARS characters at most,
    and each text is searched for all of an automaton's quotes in one pass, with no shuffle. Blank
    and null quotes are nowhere.
    """
    asked = quotes.select("qid", match_text(F.col("quote")).alias("q")).where("q <> ''")
    own = texts.where("text is not null").select("id", match_text(F.col("text")).alias("body"))
    schema = f"qid {dict(quotes.dtypes)['qid']}, id {dict(texts.dtypes)['id']}"
    kind = pa.field("qid", to_arrow_type(asked.schema["qid"].dataType)).type
    found, block, size = [], [], 0
    for row in asked.toLocalIterator():
        if block and size + len(row.q) > QUOTE_CHARS:
            found.append(stored(own.mapInArrow(_searcher(block, kind), schema), "quotes"))
            block, size = [], 0
        block.append((row.qid, row.q))
        size += len(row.q)
    last = own.mapInArrow(_searcher(block, kind), schema)
    return reduce(DataFrame.unionByName, [*found, last])


def _searcher(quotes: list[tuple], kind: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str, list] = {}
        for qid, q in quotes:
            asked.setdefault(q, []).append(qid)
        automaton = ahocorasick.Automaton()
        for q, qids in asked.items():
            automaton.add_word(q, qids)
        automaton.make_automaton()
        for batch in batches:
            qids, rows = [], []
            for row, body in enumerate(batch.column("body").to_pylist()):
                for own in {id(x): x for _, x in (automaton.iter(body) if asked else ())}.values():
                    qids += own
                    rows += [row] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(qids, kind), batch.column("id").take(pa.array(rows, pa.int64()))], ["qid", "id"])

    return run


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked(qid, rank, id), gold(qid, id) -> (qid, first_rank) of every query that is ranked; null without a hit."""
    marked = ranked.join(gold.select("qid", "id", F.lit(True).alias("is_gold")).distinct(), ["qid", "id"], "left")
    return marked.groupBy("qid").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_rank"))


def reached(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked(qid, rank, n_tokens, ...) -> its rows before which fewer tokens than the budget are ranked."""
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("used", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).where(F.col("used") < budget).drop("used")


def hit_within_tokens(ranked: DataFrame, budget: int) -> DataFrame:
    """ranked(qid, rank, n_tokens, is_hit) -> (qid, hit): a hit counts if the tokens ranked before it are under the budget."""
    before = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    reached = ranked.withColumn("used", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return reached.groupBy("qid").agg(F.coalesce(F.max(F.when((F.col("used") < budget) & F.col("is_hit"), 1.0)), F.lit(0.0)).alias("hit"))


def audit_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest(doc_id, sha256), files(doc_id, content) -> (doc_id, problem): missing, sha256 mismatch or unlisted."""
    there = files.select(F.col("doc_id").alias("f"), F.sha2(F.col("content").cast("binary"), 256).alias("found"))
    both = manifest.join(there, F.col("doc_id") == F.col("f"), "full")
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("doc_id").isNull(), "unlisted").when(F.col("sha256") != F.col("found"), "sha256 mismatch")
    return both.select(F.coalesce("doc_id", "f").alias("doc_id"), problem.alias("problem")).where("problem is not null")

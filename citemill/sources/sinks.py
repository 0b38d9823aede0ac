"""Sinks: JSON lines, append-only records, keyed caches, the index, and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, keep_nulls: bool = False, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Sorted by doc_id across the files written."""
    write_jsonl(manifest.orderBy("doc_id"), path, keep_nulls=True)


def append_records(records: DataFrame, run_dir: str) -> None:
    """JSON lines below the run's folder, as ``files.read_records`` reads them; a run resumes after what is there."""
    records.write.mode("append").option("ignoreNullFields", False).json(f"{run_dir}/records")


def upsert(rows: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Old rows without those that a new row's key replaces, and the new rows."""
    return old.join(rows.select(key), key, "left_anti").unionByName(rows)


def write_index(path: str, chunks: DataFrame, vectors: DataFrame, postings: DataFrame, meta: dict) -> None:
    """Chunks, unit vectors, postings and what they were built from, all overwritten."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.withColumn("norm", norm).where("norm > 0").select("id", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    unit.write.mode("overwrite").parquet(f"{path}/vectors")
    postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    spark = chunks.sparkSession
    told = json.dumps({**meta, "n_chunks": spark.read.parquet(f"{path}/chunks").count()}, sort_keys=True)
    spark.createDataFrame([(told,)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str, meta: dict) -> dict[str, DataFrame]:
    """The index's tables; an index that was built from something else is an error."""
    told = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first().meta)
    chunks = spark.read.parquet(f"{path}/chunks")
    if told != json.loads(json.dumps({**meta, "n_chunks": chunks.count()})):  # as it was written: tuples are lists
        raise ValueError("the index is stale: rebuild it")
    return {"chunks": chunks, "vectors": spark.read.parquet(f"{path}/vectors"), "postings": spark.read.parquet(f"{path}/postings")}


def report_markdown(summary: DataFrame) -> str:
    """summary(config, metric, mean, low, high, n): a table with a line per metric and a column per configuration.

    A report has some dozens of rows; this is where they meet the driver.
    """
    rows = summary.collect()
    configs, metrics = sorted({r.config for r in rows}), sorted({r.metric for r in rows})
    cell = {(r.config, r.metric): f"{r['mean'] * 100:.1f} % [{r.low * 100:.1f}, {r.high * 100:.1f}], n={r.n}" for r in rows if r["mean"] is not None}
    lines = ["| metric | " + " | ".join(configs) + " |", "|---" * (len(configs) + 1) + "|"]
    return "\n".join(lines + [f"| {m} | " + " | ".join(cell.get((c, m), "n/a") for c in configs) + " |" for m in metrics]) + "\n"


def replace_block(page: str, begin: str, end: str, block: str) -> str:
    """The text between two markers replaced; a page without them is an error."""
    before, found, rest = page.partition(begin)
    _, found_end, after = rest.partition(end)
    if not (found and found_end):
        raise ValueError("the markers aren't there")
    return f"{before}{begin}\n{block.strip()}\n{end}{after}"


def review_sheet(questions: DataFrame, urls: DataFrame) -> DataFrame:
    """questions (``schemas.QUESTION``), urls(doc_id, published_url) -> (id, category, block): a block of Markdown for each question to review."""
    quotes = questions.select("id", F.posexplode("evidence").alias("pos", "e")).join(urls.select(F.col("doc_id").alias("d"), "published_url"), F.col("e.doc_id") == F.col("d"), "left")
    line = F.format_string('- evidence ([source](%s)): "%s"', F.coalesce("published_url", "e.doc_id"), F.col("e.quote"))
    listed = quotes.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("quotes"))
    head = F.concat(F.format_string("### %s · expected: `%s`", "id", "expected"), F.coalesce(F.concat(F.lit(" · "), "subtype"), F.lit("")))
    block = F.concat_ws("\n", head, F.concat(F.lit("**Q:** "), "question"), F.concat(F.lit("**Reference:** "), "reference_answer"), "quotes", F.lit("\nVerdict: \n"))
    return questions.join(listed, "id", "left").select("id", "category", block.alias("block"))


def judge_sheet(records: DataFrame) -> DataFrame:
    """records(config, qid, category, expected, question, reference, answer) -> (config, qid, block): what a person grades, the judge's grade hidden."""
    kind = F.concat("category", F.when(F.col("expected") == "correct_premise", ", false premise").otherwise(""))
    block = F.format_string(
        "### %s / %s\n\n**Question** (%s): %s\n\n**Reference answer:** %s\n\n**Assistant's answer:** %s\n\nYour grade (2/1/0): \n",
        "config", "qid", kind, "question", F.coalesce("reference", F.lit("(none)")), "answer",
    )
    return records.select("config", "qid", block.alias("block"))


def write_sheet(blocks: DataFrame, path: str, title: str, *order: str) -> None:
    """A sheet is a sample for people, so one file: the title, then the blocks in order."""
    body = [r.block for r in blocks.orderBy(*order).select("block").collect()]
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write("\n".join([f"# {title}\n", *body]))


def write_json(told: dict, path: str) -> None:
    """A small document, such as a run's fingerprint."""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(told, f, indent=2, sort_keys=True)

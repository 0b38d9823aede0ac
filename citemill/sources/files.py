"""Sources: corpora of files, JSON lines, curation and review sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


@dataclass(frozen=True)
class CorpusConfig:
    """Which files of a repository belong to the corpus, and where they are published."""

    repo: str
    commit: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = (".md", ".mdx")
    strip_prefix: str = ""
    url_template: str = "https://docs.example.org/{path}"
    source_template: str = "https://git.example.org/{repo}/blob/{commit}/{path}"
    license: str = ""

    @staticmethod
    def load(path: str) -> CorpusConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
        return CorpusConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def wants(path: Column, cfg: CorpusConfig) -> Column:
    """Any include prefix, no exclude prefix, any extension."""
    starts = lambda prefixes: _any([F.startswith(path, F.lit(p)) for p in prefixes])
    return starts(cfg.include) & ~starts(cfg.exclude) & _any([F.endswith(path, F.lit(e)) for e in cfg.extensions])


def _without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 2**31 - 1)).otherwise(text) if prefix else text


def _without_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def published_url(path: Column, cfg: CorpusConfig) -> Column:
    short = _without_prefix(path, cfg.strip_prefix)
    for suffix in (*cfg.extensions, "/index", "index"):
        short = _without_suffix(short, suffix)
    return F.replace(F.lit(cfg.url_template), F.lit("{path}"), F.regexp_replace(short, "/+$", ""))


def source_url(path: Column, cfg: CorpusConfig) -> Column:
    return F.replace(F.lit(cfg.source_template.replace("{repo}", cfg.repo).replace("{commit}", cfg.commit)), F.lit("{path}"), path)


def read_corpus(spark: SparkSession, root: str, cfg: CorpusConfig) -> DataFrame:
    """A local or remote mirror as (doc_id, path, content, text), the path predicate applied before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_extract("path", rf"{root.split('://')[-1].rstrip('/')}/(.*)$", 1)
    named = files.withColumn("local", path).where(wants(F.col("local"), cfg))
    return named.select(F.col("local").alias("doc_id"), F.col("path"), "content", F.col("content").cast("string").alias("text"))


def manifest_of(corpus: DataFrame, cfg: CorpusConfig) -> DataFrame:
    """One provenance row per file."""
    return corpus.select(
        "doc_id", F.col("doc_id").alias("local_path"), source_url(F.col("doc_id"), cfg).alias("source_url"), published_url(F.col("doc_id"), cfg).alias("published_url"),
        F.lit(cfg.repo).alias("repo"), F.lit(cfg.commit).alias("commit"), F.lit(cfg.license).alias("license"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("retrieved_at"),
        F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("bytes"),
    )


def fetch_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines give no row, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, run_dir: str) -> DataFrame:
    """All records of a run: those of ``sinks.append_records``, and files that are named by their configuration (its name is then the file's stem). Fields that older files lack get defaults."""
    rows = spark.read.schema(schemas.RECORD).option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(f"{run_dir}/records")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1)
    filled = {k: F.coalesce(F.col(k), F.lit(v)) for k, v in schemas.DEFAULTS.items()}
    return rows.withColumns({"config": F.when(stem != "", stem).otherwise(F.col("config")), **filled})


def read_curation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Small tables drop(id), rewrite(id, new_question, new_reference), recategorize(id, new_category); empty without a file."""
    import os

    data: dict = {}
    if os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
    rewrite = data.get("rewrite") or {}
    return {
        "drop": spark.createDataFrame([(k,) for k in data.get("drop") or {}], "id string"),
        "rewrite": spark.createDataFrame([(k, v.get("question"), v.get("reference")) for k, v in rewrite.items()], "id string, new_question string, new_reference string"),
        "recategorize": spark.createDataFrame([(k, str(v)) for k, v in (data.get("recategorize") or {}).items()], "id string, new_category string"),
    }


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "text")


def pending(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: what has no record yet."""
    return questions.join(done.select("qid").distinct(), questions.id == done.qid, "left_anti")

"""A question set filled to its quotas, in rounds that are kept: a run that stops goes on where it was.

A round asks, for each kind of question, for what is still wanted over the share that held so far, all
in one batch for the model. What held and what was tried are written at the round's end, so the next
round and the next run ask about nothing twice; behind ``answering.Cached`` clients not even a round
that was cut off pays again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions.text import has_numeric
from citemill.operators import answering, drafting, fusion
from citemill.sources import schemas
from citemill.sources.store import stored

from .assistant import found_for

#: Kinds of questions that one section gives: (category, subtype) and what is expected of the assistant.
SINGLE = {
    ("numeric", None): "answer", ("factual", None): "answer",
    ("adversarial", "false_premise"): "correct_premise", ("adversarial", "outdated_term"): "answer",
}
PAIRS, UNANSWERABLE, MANUAL = ("multi_section", None), ("unanswerable", None), ("adversarial", "other_protocol")
#: Characters of a section by which its neighbour in another document is sought.
QUERY_CHARS = 300
#: Excerpts that a verifier is shown.
SHOWN = 5

_TRIED = "category string, subtype string, notes string"


@dataclass(frozen=True)
class Builder:
    """``path`` keeps the rounds; ``index`` finds neighbours and excerpts; templates by kind, and ``verify`` for candidates without an answer."""

    path: str
    index: dict[str, DataFrame]
    writer: answering.Client
    verifier: answering.Client
    templates: dict[tuple[str, str | None], str]
    verify: str
    targets: dict[tuple[str, str | None], int] = field(default_factory=lambda: dict(drafting.TARGETS))
    manual: tuple[str, ...] = ()
    mode: str = "hybrid"
    seed: int = 7

    def _rounds(self, spark, name: str, schema: str) -> DataFrame:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        done = [x.getPath().toString() for x in files.listStatus(where)] if files.exists(where) else []
        return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)

    def questions(self, spark) -> DataFrame:
        """What the rounds so far have accepted (``schemas.QUESTION``)."""
        return self._rounds(spark, "questions", schemas.QUESTION)

    def build(self, sections: DataFrame, existing: DataFrame | None = None, rounds: int = 6) -> DataFrame:
        """sections(doc_id, heading_path, text, area), existing questions (``schemas.QUESTION``) -> what was accepted.

        Goes on until every target is met, a round finds nothing to ask about, or ``rounds`` are over.
        """
        spark = sections.sparkSession
        key = F.md5(F.concat_ws(":", F.lit(str(self.seed)), "notes", "text").cast("binary"))
        named = sections.withColumn("notes", drafting.section_key(F.col("doc_id"), F.col("heading_path")))
        named = stored(named.withColumn("did", key).dropDuplicates(["notes"]), "sections")
        for _ in range(rounds):
            if not self._round(spark, named, existing):
                break
        return self.questions(spark)

    def _round(self, spark, sections: DataFrame, existing: DataFrame | None) -> bool:
        kept, tried = self.questions(spark), self._rounds(spark, "tried", _TRIED)
        whole = kept if existing is None else kept.unionByName(existing.select(kept.columns))
        have = {(r.category, r.subtype): r["count"] for r in whole.groupBy("category", "subtype").count().collect()}  # a row for each kind
        accepted = {(r.category, r.subtype): r["count"] for r in kept.groupBy("category", "subtype").count().collect()}
        asked = {(r.category, r.subtype): r["count"] for r in tried.groupBy("category", "subtype").count().collect()}
        used = stored(tried.select("notes").union(whole.select("notes")).where("notes is not null").distinct(), "used")
        fresh = stored(sections.join(used, "notes", "left_anti"), "fresh")
        good, notes = [], []
        for kind, target in self.targets.items():
            want = target - have.get(kind, 0)
            if want <= 0 or kind not in self.templates and kind != MANUAL:
                continue
            # Laplace's rule for the share that will hold.
            share = (accepted.get(kind, 0) + 1) / (asked.get(kind, 0) + 2)
            made, looked = self._kind(spark, kind, want, math.ceil(want / share), fresh, sections, used)
            if made is not None:
                good.append(stored(made, "accepted"))
            if looked is not None:
                looked = stored(looked, "tried")
                notes.append(looked.select(F.lit(kind[0]).alias("category"), F.lit(kind[1]).cast("string").alias("subtype"), "notes"))
                fresh = fresh.join(looked.select("notes"), "notes", "left_anti")
        if not any(n.head(1) for n in notes):
            return False
        number = len(set(self._numbers(spark)))
        both = [(good, "questions", schemas.QUESTION), (notes, "tried", _TRIED)]
        for parts, name, schema in both:
            rows = spark.createDataFrame([], schema)
            for part in parts:
                rows = rows.unionByName(part)
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/round={number}")
        return True

    def _numbers(self, spark) -> list[int]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tried")
        files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return [int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(where)] if files.exists(where) else []

    def _kind(self, spark, kind, want: int, n: int, fresh: DataFrame, sections: DataFrame, used: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """(questions that hold, ``want`` at most; what was asked about) of one kind in one round."""
        if kind == MANUAL:
            return self._manual(spark, want, used)
        if kind == UNANSWERABLE:
            return self._unanswerable(want, sections, used)
        left = fresh.where(has_numeric(F.col("text"))) if kind[0] == "numeric" else fresh
        chosen = stored(left.orderBy("did").limit(n), "chosen")
        if kind == PAIRS:
            pairs = self._pairs(chosen)
            drafts = drafting.draft_pairs(pairs, self.writer, self.templates[kind]).join(pairs.select("did", "notes"), "did")
            return drafting.make_questions(drafts.orderBy("did").limit(want), *kind, "answer"), chosen.select("notes")
        drafts = drafting.draft(chosen.select("did", "doc_id", F.array_join("heading_path", " > ").alias("heading"), "text"), self.writer, self.templates[kind])
        return drafting.make_questions(drafts.join(chosen.select("did", "notes"), "did").orderBy("did").limit(want), *kind, SINGLE[kind]), chosen.select("notes")

    def _near(self, asked: DataFrame) -> DataFrame:
        """asked(qid, question) -> (qid, rank, doc_id, heading, text) of the chunks found."""
        found, _ = found_for(asked, self.index, self.mode, SHOWN)
        chunks = self.index["chunks"].select(F.col("chunk_id").alias("id"), "doc_id", F.array_join("heading_path", " > ").alias("heading"), "text")
        return found.select("qid", "rank", "id").join(chunks, "id")

    def _pairs(self, chosen: DataFrame) -> DataFrame:
        """Each section with the nearest chunk of another document; those without one are left out."""
        path = F.array_join("heading_path", " > ")
        near = self._near(chosen.select(F.col("did").alias("qid"), F.concat(path, F.lit(". "), F.substring("text", 1, QUERY_CHARS)).alias("question")))
        own = near.join(chosen.select(F.col("did").alias("qid"), F.col("doc_id").alias("own_doc")), "qid")
        other = fusion.first_of_other_document(own, F.col("own_doc"), F.col("doc_id")).select("qid", "id")
        b = near.join(other, ["qid", "id"]).select(F.col("qid").alias("did"), F.struct("doc_id", "heading", "text").alias("b"))
        a = chosen.select("did", F.struct("doc_id", path.alias("heading"), "text").alias("a"), "notes")
        return stored(a.join(b, "did").withColumn("notes", F.concat("notes", F.lit(" || "), F.col("b.doc_id"), F.lit(" :: "), F.col("b.heading"))), "pairs")

    def _unanswerable(self, want: int, sections: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidates from headings of each area, other ones in each round, of which a verifier finds no answer in what is found."""
        spark = sections.sparkSession
        areas = sections.select("area", F.array_join("heading_path", " > ").alias("heading"))
        said = drafting.draft_unanswerable(areas, self.writer, self.templates[UNANSWERABLE], seed=self.seed + len(self._numbers(spark)))
        fresh = said.select("question").distinct().withColumn("notes", F.concat(F.lit("unans: "), "question")).join(used, "notes", "left_anti")
        fresh = stored(fresh.withColumn("qid", F.md5(F.concat_ws(":", F.lit(str(self.seed)), "question").cast("binary"))), "candidates")
        context = self._near(fresh).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
        shown = fresh.join(context, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
        holds = drafting.verified_unanswerable(shown, self.verifier, self.verify).where("holds").select("qid")
        return drafting.make_questions(self._bare(fresh.join(holds, "qid")).orderBy("did").limit(want), *UNANSWERABLE, "abstain"), fresh.select("notes")

    def _manual(self, spark, want: int, used: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Questions that people wrote, in their order."""
        rows = spark.createDataFrame([(f"{i:04}", q, f"manual-other-protocol-{i}") for i, q in enumerate(self.manual)], "qid string, question string, notes string")
        some = stored(rows.join(used, "notes", "left_anti").orderBy("qid").limit(want), "manual")
        return drafting.make_questions(self._bare(some), *MANUAL, "abstain", source="manual"), some.select("notes")

    @staticmethod
    def _bare(rows: DataFrame) -> DataFrame:
        none: Column = F.array().cast("array<struct<doc_id:string,quote:string,pos:int>>")
        return rows.select(F.col("qid").alias("did"), "question", F.lit(None).cast("string").alias("reference_answer"), none.alias("evidence"), "notes")

import pytest
from pyspark.sql import functions as F

from citemill.operators import bm25, dense, evidence
from citemill.sources import files, schemas, sinks

CFG = files.CorpusConfig("org/docs", "c0ffee", ("docs/",), ("docs/old",), strip_prefix="docs/", url_template="https://x.example/{path}")


@pytest.mark.parametrize("path, wanted, url", [("docs/a.mdx", True, "https://x.example/a"), ("docs/b/index.md", True, "https://x.example/b"), ("docs/index.md", True, "https://x.example/"), ("docs/old/a.md", False, None), ("src/a.md", False, None), ("docs/a.png", False, None)])
def test_paths(spark, path, wanted, url):
    r = spark.createDataFrame([(path,)], "p string").select(files.wants(F.col("p"), CFG).alias("w"), files.published_url(F.col("p"), CFG).alias("u")).first()
    assert r.w == wanted and (url is None or r.u == url)


def test_corpus_manifest_and_audit(spark, tmp_path):
    for name in ("docs/a.md", "docs/old/x.md", "docs/b/c.mdx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text of " + name)
    corpus = files.read_corpus(spark, str(tmp_path), CFG)
    manifest = files.manifest_of(corpus, CFG)
    assert [r.doc_id for r in manifest.orderBy("doc_id").collect()] == ["docs/a.md", "docs/b/c.mdx"] and manifest.schema.simpleString().startswith("struct<doc_id")
    sinks.write_manifest(manifest, str(tmp_path / "m"))
    back = files.read_jsonl(spark, str(tmp_path / "m"), schemas.MANIFEST)
    (tmp_path / "docs/a.md").write_text("changed")
    (tmp_path / "docs/new.md").write_text("new")
    got = {r.doc_id: r.problem for r in evidence.audit_manifest(back, files.read_corpus(spark, str(tmp_path), CFG)).collect()}
    assert got == {"docs/a.md": "sha256 mismatch", "docs/new.md": "unlisted"}


def test_questions_leave_nulls_out_and_records_read_old_files(spark, tmp_path):
    q = spark.createDataFrame([("q1", None, None)], "id string, split string, notes string")
    sinks.write_jsonl(q, str(tmp_path / "q"))
    assert '{"id":"q1"}' in "".join(p.read_text() for p in (tmp_path / "q").glob("part-*"))
    (tmp_path / "run/records").mkdir(parents=True)
    (tmp_path / "run/records/hybrid.jsonl").write_text('{"qid": "q1", "expected": "answer"}\n\n')
    r = files.read_records(spark, str(tmp_path / "run")).first()
    assert (r.config, r.abstained, r.citations_requested) == ("hybrid", False, True)
    own = spark.createDataFrame([("q2", "dense", None), ("q3", "a/b", 1)], "qid string, config string, n_llm_calls int")
    sinks.append_records(own, str(tmp_path / "run"))
    sinks.append_records(own.where("qid = 'q3'").replace("q3", "q4"), str(tmp_path / "run"))
    got = {(r.config, r.qid, r.n_llm_calls) for r in files.read_records(spark, str(tmp_path / "run")).collect()}
    assert got == {("hybrid", "q1", 0), ("dense", "q2", 0), ("a/b", "q3", 1), ("a/b", "q4", 1)}


def test_upsert_and_resume(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in sinks.upsert(new, old, "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    q = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in files.pending(q, spark.createDataFrame([("a",)], "qid string")).collect()] == ["z"]


def test_curation_file(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("drop: {q1: why}\nrewrite:\n  q2: {question: new}\n")
    got = files.read_curation(spark, str(tmp_path / "c.yaml"))
    assert got["drop"].first().id == "q1" and got["rewrite"].first().new_question == "new" and got["recategorize"].count() == 0
    assert files.read_curation(spark, str(tmp_path / "none.yaml"))["drop"].count() == 0


def test_index_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([(1, "swap fee"), (2, "pool")], "id int, text string")
    meta = {"model": "m", "chunking": "256/32"}
    sinks.write_index(str(tmp_path / "i"), texts, dense.embed(texts), bm25.build(texts).postings, meta)
    got = sinks.read_index(spark, str(tmp_path / "i"), meta)
    asked = spark.createDataFrame([("q", "fee")], "qid string, text string")
    assert bm25.search(asked, bm25.Index(got["postings"]), 3).first().id == 1
    with pytest.raises(ValueError):
        sinks.read_index(spark, str(tmp_path / "i"), meta | {"model": "n"})


def test_report(spark):
    rows = spark.createDataFrame([("a", "hit", 0.5, 0.4, 0.6, 10)], "config string, metric string, mean double, low double, high double, n int")
    table = sinks.report_markdown(rows)
    assert "| hit | 50.0 % [40.0, 60.0], n=10 |" in table
    assert sinks.replace_block("x <!--a--> old <!--b--> y", "<!--a-->", "<!--b-->", table).count("50.0") == 1
    with pytest.raises(ValueError):
        sinks.replace_block("x", "<!--a-->", "<!--b-->", table)

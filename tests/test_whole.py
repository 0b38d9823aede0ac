"""Registered queries over tables of a few rows on which a cut shows."""

from citemill.plans import registry
from tests.test_statistics import drawn


def tables(spark, path, **given):
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_token_budget_reaches_past_rank_50(spark, tmp_path):
    quote = "red fox jumps over lazy dogs today"
    docs = [(i, "dogs lazy jumps fox red today") for i in range(60)] + [(60, quote + " and some other words here" * 4)]
    docs += [(100 + i, "nothing of it, many other things instead") for i in range(300)]
    far = [(400 + i, "blue whale " * 40) for i in range(60)] + [(500, "a blue whale swims under old ships " + "at sea " * 200)]
    d = tables(spark, tmp_path, documents=(docs + far, "doc_id bigint, text string"), benchmark=([(1, quote), (2, "blue whale swims under old ships")], "item_id bigint, text string"))
    assert {r.qid: r.hit for r in registry.queries()["hit_at_token_budget"](spark, d).collect()} == {1: 1.0, 2: 0.0}


LABELLED = [(i, ("en", None, "fr")[i % 3], int(i % 4 > 0), int(i % 5 == 0)) for i in range(60)]


def labelled(spark, path):
    labels = [(i, None if i == 7 else q, t) for i, _, q, t in LABELLED]
    return tables(spark, path, documents=([(i, lang) for i, lang, _, _ in LABELLED], "doc_id bigint, lang string"), labels=(labels, "doc_id bigint, quality int, toxic int"))


def test_paired_differences_of_all_languages(spark, tmp_path):
    got = {r.grp: r for r in registry.queries()["paired_bootstrap_diff"](spark, labelled(spark, tmp_path)).collect()}
    want = {lang: [q - t for i, at, q, t in LABELLED if at == lang and i != 7] for lang in ("en", None, "fr")}
    keys = {lang: [i for i, at, _, _ in LABELLED if at == lang and i != 7] for lang in want}
    assert {g: (r.n, r["mean"]) for g, r in got.items()} == {g: (len(v), round(sum(v) / len(v), 6)) for g, v in want.items()}
    for g, v in want.items():
        means = []
        for b in range(2000):
            w = [drawn(k, b) for k in keys[g]]
            means.append(sum(x * y for x, y in zip(w, v)) / sum(w) if sum(w) else sum(v) / len(v))
        means.sort()
        assert (got[g].low, got[g].high) == (round(means[50], 6), round(means[1950], 6))


def test_all_labels_are_human_grades(spark, tmp_path):
    got = {(r.config, r.qid, r.human, r.judge) for r in registry.queries()["rater_disagreements"](spark, labelled(spark, tmp_path)).collect()}
    assert got == {(f"c{i % 3}", i, q, t) for i, _, q, t in LABELLED if q != t and i != 7}


def test_all_configurations_against_both_baselines(spark, small):
    from citemill.operators import bootstrap, metrics
    from citemill.plans import evaluation_queries as e

    got = {(r.baseline, r.config, r.metric): r for r in registry.queries()["all_vs_baseline"](spark, small).collect()}
    value = {(r.config, r.qid, r.metric): r.value for r in metrics.long_form(metrics.per_question(e.records(spark, small))).collect()}
    want = {}
    for (config, qid, metric), v in value.items():
        for base in ("naive", "dense"):
            if config != base and (base, qid, metric) in value:
                want.setdefault((base, config, metric), []).append(v - value[base, qid, metric])
    assert {k: r.n for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert {(b, c) for b, c, _ in got} == {(b, c) for b in ("naive", "dense") for c in e.CONFIGS if c != b}
    for k, v in want.items():
        assert abs(got[k].difference - sum(v) / len(v)) < 2e-6 and got[k].low <= got[k].difference <= got[k].high
    drawn = spark.createDataFrame([(*k, i, x) for k in [("dense", "hybrid", "hit_5"), ("naive", "dense", "correctness")] for i, x in enumerate(want[k])], "b string, c string, m string, key int, value double")
    for r in bootstrap.bootstrap_ci(drawn.selectExpr("struct(b, c, m) as grp", "key", "value")).collect():
        assert abs(got[tuple(r.grp)].low - r.low) < 0.03 and abs(got[tuple(r.grp)].high - r.high) < 0.03


def test_each_section_is_a_draft(spark, tmp_path):
    body = {k: " ".join(f"{k}{i}" for i in range(n)) for k, n in (("a", 800), ("b", 90), ("c", 59), ("d", 61), ("e", 900))}
    docs = [(1, f"# One\n\n{body['a']}\n\n## Two\n\n{body['b']}\n\n## Three\n\n{body['c']}\n\nFour\n====\n\n{body['d']}\n"), (2, body["e"]), (3, body["c"]), (4, None), (5, "# Only a heading")]
    got = sorted((r.doc_id, r.n_words, r.section) for r in registry.queries()["drafting_sections"](spark, tables(spark, tmp_path, documents=(docs, "doc_id bigint, text string"))).collect())
    assert got == sorted((i, len(w), " ".join(w[:700])) for i, k in ((1, "a"), (1, "b"), (1, "d"), (2, "e")) for w in [body[k].split(" ")])

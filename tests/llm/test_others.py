"""Operators on vectors, conversations and pages, and the pipeline."""

import numpy as np
import pytest
from compare import connect, differences

import corpus_pipeline
from citemill.llm import components, line_dedup, queries, quotations, vector_dedup

ODD_VECTORS = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, [float("inf"), 1.0]), (None, [1.0, 0.0])]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, name):
    assert differences(spark, connect(small), queries.queries()[name], queries.oracle_sql()[name], small) == ""


def test_odd_vectors(spark):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in ODD_VECTORS], "vec_id bigint, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    assert all(got[i].n_links == 0 and got[i].kept for i in (1, 2, 3, 4, 5, 9, 10))
    assert all(got[i].n_links == 3 and got[i].component_id == 6 for i in (6, 7, 8, None)) and got[6].kept and not got[8].kept
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 16)  # many blocks in a hot filter
    rng = np.random.default_rng(2)
    x = rng.standard_normal((250, 32))
    near = x[:40].repeat(3, 0) + rng.standard_normal((120, 32)) * 0.2
    hot = x[:1] + rng.standard_normal((60, 32)) * 0.12
    v = np.concatenate([x, near, hot, x[:5]]).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    links = np.array([got[i].n_links for i in range(len(v))])
    assert (links <= linked.sum(1)).all() and links.sum() >= 0.99 * linked.sum() > 1000
    root = np.arange(len(v))
    while True:
        new = np.array([min(root[i], root[linked[i]].min(initial=len(v))) for i in range(len(v))])
        if (new == root).all():
            break
        root = new
    assert np.mean([got[i].component_id == root[i] for i in range(len(v))]) >= 0.99


def sharing_a_direction(n, dim, mean_cosine, seed):
    """Unit vectors whose pairs have that cosine on average, as those of a text model have."""
    x = np.random.default_rng(seed).standard_normal((n, dim)) / np.sqrt(dim)
    x[:, 0] += np.sqrt(mean_cosine / (1 - mean_cosine))
    return vector_dedup.unit_rows(x)


@pytest.mark.parametrize("n, dim, mean_cosine", [
    (500, 2, 0), (50_000, 2, 0), (50_000, 3, 0), (50_000, 5, 0), (50_000, 8, 0), (50_000, 16, 0.3), (50_000, 64, 0), (50_000, 64, 0.6), (50_000, 64, 0.8),
    (50_000, 1024, 0), (50_000, 1024, 0.8), (10**7, 64, 0), (10**7, 64, 0.6),
])
def test_recall_and_copies_whatever_the_dimension_and_direction(n, dim, mean_cosine):
    filters = vector_dedup.fit(sharing_a_direction(2048, dim, mean_cosine, 0), n, 0.95)
    fresh = sharing_a_direction(3000, dim, mean_cosine, 1)  # none of those that the filters were fitted on
    recall, copies = vector_dedup.measured(filters, fresh, 0.95, 600, seed=5)
    assert recall >= 0.98 and copies < 40


@pytest.mark.parametrize("dim, mean_cosine, spread", [(2, 0, 0.01), (3, 0, 0.05), (48, 0.6, 0.03), (48, 0.8, 0.03)])
def test_few_dimensions_and_shared_directions_against_brute_force(spark, dim, mean_cosine, spread):
    own = sharing_a_direction(900, dim, mean_cosine, 2)
    v = np.concatenate([own, own[:300] + spread * np.random.default_rng(3).standard_normal((300, dim))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_vectors(df).collect()}
    unit = vector_dedup.unit_rows(v)
    linked = unit @ unit.T >= 0.95
    links, want = np.array([got[i] for i in range(len(v))]), linked.sum(1) - 1
    assert (links <= want).all() and links.sum() >= 0.98 * want.sum() > 400


def test_list_decoding_is_complete():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((20, 12))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rotation, code = vector_dedup.product_code(12, 9)
    need, fewest = 1.0 / np.sqrt(12) * np.sqrt(2), 12
    turned = u @ rotation
    for row, ids in enumerate(vector_dedup.Filters(12, 9, need, fewest, np.zeros(12)).decode(u)):
        sums = (turned[row, :6] @ code[0].T)[:, None] + (turned[row, 6:] @ code[1].T)[None]
        want = set(np.flatnonzero(sums.ravel() >= need).tolist())
        assert want <= set(ids.tolist()) and (len(want) < fewest or want == set(ids.tolist()))


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 99) for i in range(1, 30)] + [(205, 203), (205, 201), (204, 203)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "hi bigint, lo bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 99 for i in range(99, 129) if i != 100} | {100 + i: 99 for i in range(1, 30)} | {i: 201 for i in (201, 203, 204, 205)} | {99: 99}
    assert components.components(spark.createDataFrame([], "hi bigint, lo bigint")).count() == 0


MESSAGES = [
    (1, 0, "user", "Hello there my friend.\nHow are you doing today?"), (1, 1, "assistant", "> How are you doing today?\nFine thanks for asking."), (1, 2, "user", "Something unrelated entirely"),
    (1, 3, "user", "On Monday X wrote:\n> Fine thanks for asking.\n>> How are you doing today?\nGood to hear that indeed"), (2, 0, "user", "> Something unrelated\n> entirely\nindeed so"),
    (1, 4, "user", "> Good to hear that\n> indeed\nok"), (None, 1, "user", "> Fine thanks for asking."), (3, None, None, None), (2, 0, "user", "> Something unrelated\n> entirely\nindeed so"), (4, 0, "user", ""),
]


def test_quotations(spark):
    df = spark.createDataFrame([(*m, "x", "y") for m in MESSAGES], "conv_id bigint, turn bigint, role string, text string, own string, quoted string")
    got = quotations.link_quotations(df)
    rows = got.collect()
    at = {(r.conv_id, r.turn): (r.parent_conv, r.parent_turn, r.thread_conv, r.thread_turn, r.depth) for r in rows}
    assert len(rows) == len(MESSAGES)
    assert at[1, 1] == (1, 0, 1, 0, 1) and at[1, 3] == (1, 1, 1, 0, 2) and at[1, 4] == (1, 3, 1, 0, 3) and at[2, 0] == (1, 2, 1, 2, 1)
    assert at[1, 2] == (None, None, 1, 2, 0) and at[None, 1][0] is None and at[3, None] == (None, None, 3, None, 0)
    assert {r.text for r in rows if r.turn == 3} == {"Good to hear that indeed"}
    order = [r.turn for r in got.where("conv_id = 1").orderBy("thread_conv", "thread_turn", "turn").collect()]
    assert order == [0, 1, 3, 4, 2]
    assert quotations.link_quotations(df.limit(0)).count() == 0


def test_a_line_everyone_quotes_makes_one_link_each(spark):
    rows = [(c, t, "user", "> please see the rules first\nmine %d %d" % (c, t) if t else "please see the rules first") for c in range(30) for t in range(5)]
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert all((r.parent_conv, r.parent_turn) == ((r.conv_id, 0) if r.turn else (None, None)) for r in got) and len(got) == 150


@pytest.mark.parametrize("hot_share", [256, 2, 0])  # all hosts large, one of them, none
def test_lines(spark, monkeypatch, hot_share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot_share)
    pages = [(i, f"https://u@A.example:80/p{i}", f"<nav>Menu  here</nav><!-- x --><script>var a='<p>';</script><p>Text <b>number</b> {i}</p><br>Foot") for i in range(4)]
    pages += [(10, "http://b.example/", "<p>Menu here</p><p>own</p>"), (11, None, "<p>Foot</p>"), (12, "http://a.example/x", None), (None, "no url", ""), (10, "http://b.example/", "<p>Menu here</p>own")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id bigint, url string, html string, host string, lines string")
    got = line_dedup.drop_boilerplate(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    assert [(by[i].host, by[i].n_lines, by[i].n_dropped, by[i].text) for i in range(4)] == [("a.example", 3, 2, f"Text number {i}") for i in range(4)]
    assert by[10].n_dropped == 0 and by[11].text == "Foot" and by[12].n_lines == 0 and by[None].text == ""
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, small):
    from tests.llm.test_documents import lower
    from tests.llm.test_more import near_by_hand

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "curve_packing"]
    docs, after = spark.read.parquet(f"{small}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        after.append(docs)
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    with_letters = {i for i, t in raw.items() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in after[0].collect()} == with_letters
    last = {}
    for i in sorted(with_letters):
        last[lower(raw[i])] = i
    assert sorted(r.doc_id for r in after[1].collect()) == sorted(last.values())
    ids = sorted(last.values())
    roots = {ids[i]: ids[root] for i, root in near_by_hand([raw[i] for i in ids]).items()}
    assert sorted(r.doc_id for r in after[2].collect()) == sorted(set(roots.values()))
    mixed = after[3].collect()
    size = lambda t: len((t or "").encode().split())
    words, taken = {i: size(raw[i]) for i in set(roots.values())}, {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + size(r.text)
    assert all(taken[i] <= 2 * words[i] for i in taken) and abs(sum(taken.values()) - 1.5 * sum(words.values())) < 30
    packed = after[4].groupBy("doc_id").agg({"length": "sum"}).count()
    assert packed == len(taken) and corpus_pipeline.run(spark, small).columns == after[4].columns

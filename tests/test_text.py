from pyspark.sql import functions as F

from citemill.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_terms_keep_wholes_and_parts(spark):
    got = one(spark, T.terms(F.col("t")), t="Call Pool.initFee with sqrtPriceX96, the HTTPServer and x")
    assert got == ["call", "pool.initfee", "pool", "init", "fee", "sqrtpricex96", "sqrt", "price", "x", "96", "httpserver", "http", "server", "x"]
    assert one(spark, T.terms(F.col("t")), t="what is the") == []


def test_match_text_takes_no_break_spaces(spark):
    assert one(spark, T.match_text(F.col("t")), t=" A **bold**\n\t`Code`  x y ") == "a bold code x y"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two! three? `Four` (x). [Five] e.g. six") == ["One.", "Two! three?", "`Four` (x).", "[Five] e.g. six"]


def test_citations(spark):
    def check(answer, n=3, abstained=False, coverage=True):
        return one(spark, T.check_citations(F.col("t"), F.lit(n), F.lit(abstained), coverage), t=answer)

    assert check("It is so [S2]. And so [S1][S2].").cited == ["S2", "S1"]
    bad = check("It is so [S7].")
    assert not bad.valid and bad.unknown == ["S7"] and "S7" in bad.reason
    assert check("It is so here now.").reason == "answer has no citations"
    assert check("No idea at all here.", abstained=True).valid
    partly = check("It is so [S1]. This one has no marker.")
    assert partly.uncited_sentences == ["This one has no marker."] and not partly.valid
    assert check("It is so [S1]. This one has no marker.", coverage=False).valid
    assert check("It goes like this here:\n\n```\nA b c d. E f g h.\n```\n\nDone [S1]. Too short.").valid
    assert check("x [S1].", n=0).unknown == ["S1"]


def test_renumber_and_strip(spark):
    assert one(spark, T.renumber(F.col("t"), T.cited_aliases(F.col("t"))), t="A [S3]. B [S1][S3].") == "A [1]. B [2][1]."
    assert one(spark, T.strip_unknown_markers(F.col("t"), F.lit(2)), t="A [S3]. B [S1][S0].") == "A . B [S1]."


def test_alias_index(spark):
    for value, want in ((" s2 ", 1), ("S9", None), ("2", None), ("S", None), ("S0", None)):
        assert one(spark, T.alias_index(F.col("t"), F.lit(3)), t=value) == want


def test_parse_reply(spark):
    parse = lambda t: one(spark, T.parse_reply(F.col("t")), t=t)
    assert parse('```json\n{"answer": "a", "abstain": false}\n```').answer == "a"
    assert parse('{"answer": "a"}') is None and parse("[1]") is None and parse("x") is None
    assert parse('{"answer": "", "abstain": true, "closest_source": "S1"}').closest_source == "S1"


def test_lint_and_numeric(spark):
    flags = T.lint(F.col("q"), F.lit(True), F.lit(0), F.lit(None).cast("string"), F.lit("w " * 81))
    assert one(spark, flags, q="See the example below") == ["context-dependent wording", "very short", "no evidence", "long reference"]
    assert one(spark, T.has_numeric(F.col("t")), t="fees of 30 bps and 0xdeadbeef99") and not one(spark, T.has_numeric(F.col("t")), t="one 7")


def test_chat_html_trims_the_body_only(spark):
    df = spark.createDataFrame([("<&" * 3000, [("A \"b\"", "https://x/?a&b")])], "t string, s array<struct<label:string,url:string>>")
    none = F.lit(None).cast("struct<label:string,url:string>")
    html = df.select(T.chat_html(F.col("t"), F.col("s"), F.lit(False), none, "P").alias("x")).first().x
    assert html.endswith('\n\n<b>Sources</b>\n[1] <a href="https://x/?a&amp;b">A &quot;b&quot;</a>') and "…" in html
    short = spark.createDataFrame([("x" * 5000, [("A", "u")])], "t string, s array<struct<label:string,url:string>>")
    assert len(short.select(T.chat_html(F.col("t"), F.col("s"), F.lit(False), none, "P").alias("x")).first().x) <= T.CHAT_LIMIT
    closest = F.struct(F.lit("L").alias("label"), F.lit("U").alias("url"))
    said = short.select(T.chat_html(F.lit("no"), F.col("s"), F.lit(True), closest, "P").alias("x")).first().x
    assert said.startswith("🤷 no\n\nClosest section I found: <a href=\"U\">L</a>\n\n<i>")


def test_percent(spark):
    assert one(spark, T.percent_with_ci(F.lit(0.5), F.lit(0.4), F.lit(0.6)), t="") == "50.0 % [40.0, 60.0]"
    assert one(spark, T.percent_with_ci(F.lit(None).cast("double"), F.lit(0.4), F.lit(0.6)), t="") == "n/a"

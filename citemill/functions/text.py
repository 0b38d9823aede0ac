"""Text functions as column expressions: they stay in the JVM and take and return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words the lexical index leaves out.
STOP_WORDS = (
    "a an and are as at be by for from has have how i if in into is it its of on or that "
    "the their then there these this to was what when where which who why will with you "
    "your do does can"
).split()
#: Dotted identifiers and the parts of camel case.
IDENTIFIER = r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*"
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"
#: Where prose is cut into sentences, for chunks and for answers.
CHUNK_SENTENCE = r"(?U)(?<=[.!?])\s+(?=[A-Z`\[*(])"
ANSWER_SENTENCE = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9`\"(])"
#: Fixed value: a citation in an answer.
MARKER = r"\[S(\d+)\]"
#: Wording that leans on a passage, and numeric content.
CONTEXT_DEPENDENT = (
    r"(?i)\b(this|the) (passage|section|example|snippet|guide|page|document|code|table|text)\b"
    r"|\b(above|below|following|aforementioned)\b"
)
NUMERIC = (
    r"\b\d+(?:[.,]\d+)*\s*(?:%|bps|basis points|seconds|blocks|days|wei|gwei|bits?)\b"
    r"|\b0x[0-9a-fA-F]{8,}\b|\b\d{2,}\b"
)


def strip(text: Column) -> Column:
    """White space removed at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def match_text(text: Column) -> Column:
    """What quotes are compared by: no bold or code marks, single spaces, trimmed, lower case."""
    bare = F.regexp_replace(text, r"\*\*|`", "")
    return F.lower(strip(F.regexp_replace(bare, r"(?U)\s+", " ")))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)


def is_one_term(word: Column) -> Column:
    """Whether an identifier has no parts beside itself, as almost all words of prose."""
    return F.rlike(word, F.lit("^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"))


def identifier_terms(word: Column) -> Column:
    """The terms of one identifier: itself and, if it has several or a dot, its parts; stop words left out."""
    parts = F.flatten(F.transform(F.split(word, r"\."), lambda s: F.regexp_extract_all(s, F.lit(CAMEL), 0)))
    whole = F.array(F.lower(word))
    several = (F.size(parts) > 1) | F.contains(word, F.lit("."))
    terms = F.when(is_one_term(word), whole).when(several, F.concat(whole, F.transform(parts, lambda p: F.lower(p)))).otherwise(whole)
    return F.filter(terms, lambda t: ~t.isin(*STOP_WORDS))


def terms(text: Column) -> Column:
    """All terms of a text in order, duplicates kept."""
    return F.flatten(F.transform(identifiers(text), identifier_terms))


def sentences(text: Column, boundary: str = CHUNK_SENTENCE) -> Column:
    return F.filter(F.split(text, boundary), lambda s: strip(s) != "")


def is_context_dependent(text: Column) -> Column:
    return F.rlike(text, F.lit(CONTEXT_DEPENDENT))


def has_numeric(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NUMERIC)) >= 2


def lint(question: Column, answerable: Column, n_evidence: Column, subtype: Column, reference: Column) -> Column:
    """The red flags of a question, in fixed order."""
    return F.array_compact(F.array(
        F.when(is_context_dependent(question), "context-dependent wording"),
        F.when(word_count(question) < 5, "very short"),
        F.when(answerable & (F.coalesce(n_evidence, F.lit(0)) == 0) & ~subtype.eqNullSafe("other_protocol"), "no evidence"),
        F.when(word_count(F.coalesce(reference, F.lit(""))) > 80, "long reference"),
    ))


# ---- citations ----


def cited_aliases(text: Column) -> Column:
    """S1, S3, ... in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), 1), lambda n: F.concat(F.lit("S"), n)))


def uncited_sentences(text: Column, min_words: int = 4) -> Column:
    """Sentences of min_words words or more that carry no marker; code and lead-ins don't count."""
    prose = F.regexp_replace(text, r"(?s)```.*?```", " ")
    paragraphs = F.split(prose, r"(?U)\n\s*\n")
    found = F.flatten(F.transform(paragraphs, lambda p: F.split(strip(p), ANSWER_SENTENCE)))
    trimmed = F.transform(found, strip)
    return F.filter(trimmed, lambda s: (s != "") & ~F.endswith(s, F.lit(":")) & (word_count(s) >= min_words) & ~F.rlike(s, F.lit(MARKER)))


def check_citations(answer: Column, n_sources: Column, abstained: Column, require_coverage: bool = True) -> Column:
    """struct(valid, cited, unknown, uncited_sentences, reason); the first failing rule gives the reason."""
    cited = cited_aliases(answer)
    allowed = F.transform(F.sequence(F.lit(0), F.greatest(n_sources, F.lit(0))), lambda i: F.concat(F.lit("S"), i.cast("string")))
    unknown = F.filter(cited, lambda a: ~F.array_contains(F.slice(allowed, F.lit(2), F.greatest(n_sources, F.lit(0))), a))
    uncited = F.when(abstained, F.array().cast("array<string>")).otherwise(uncited_sentences(answer))
    reason = F.when(F.size(unknown) > 0, F.concat(F.lit("cites sources that were not retrieved: "), F.array_join(unknown, ", ")))
    reason = reason.when(~abstained & (F.size(cited) == 0), "answer has no citations")
    if require_coverage:
        reason = reason.when(F.size(uncited) > 0, F.concat(F.size(uncited).cast("string"), F.lit(" sentence(s) without a citation")))
    return F.struct(
        reason.isNull().alias("valid"), cited.alias("cited"), unknown.alias("unknown"),
        uncited.alias("uncited_sentences"), reason.alias("reason"),
    )


def strip_unknown_markers(answer: Column, n_sources: Column) -> Column:
    """Markers outside 1..n_sources are blanked."""
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit(MARKER), 1))
    wrong = F.filter(found, lambda n: ~n.cast("decimal(38,0)").between(1, n_sources))
    return F.aggregate(wrong, answer, lambda text, n: F.replace(text, F.concat(F.lit("[S"), n, F.lit("]")), F.lit("")))


def renumber(answer: Column, aliases: Column) -> Column:
    """[S3]...[S1] become [1]...[2] in the order of ``aliases``; others stay."""
    numbered = F.transform(aliases, lambda a, i: F.struct(a.alias("alias"), (i + 1).alias("n")))
    return F.aggregate(numbered, answer, lambda text, a: F.replace(text, F.concat(F.lit("["), a["alias"], F.lit("]")), F.concat(F.lit("["), a["n"].cast("string"), F.lit("]"))))


def alias_index(value: Column, n: Column) -> Column:
    """0-based place of an alias like ' s2 '; null if it isn't one of n."""
    i = F.regexp_extract(F.upper(strip(value)), r"^S\s*([+-]?\d{1,9})$", 1).try_cast("int") - 1
    return F.when((i >= 0) & (i < n), i)


def parse_reply(text: Column) -> Column:
    """struct(answer, abstain, closest_source) of a model's JSON reply, fenced or not; null if malformed."""
    bare = strip(text)
    unfenced = strip(F.regexp_replace(F.regexp_replace(bare, "^`+|`+$", ""), "^json", ""))
    body = F.when(F.startswith(bare, F.lit("```")), unfenced).otherwise(bare)
    data = F.try_parse_json(body)
    has = lambda key: F.try_variant_get(data, f"$.{key}", "variant").isNotNull()
    return F.when(
        (F.schema_of_variant(data).startswith("OBJECT")) & has("answer") & has("abstain"),
        F.struct(
            F.try_variant_get(data, "$.answer", "string").alias("answer"),
            F.coalesce(F.try_variant_get(data, "$.abstain", "boolean"), F.lit(False)).alias("abstain"),
            F.try_variant_get(data, "$.closest_source", "string").alias("closest_source"),
        ),
    )


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


#: The chat's limit of characters; the texts around links below are fixed, too.
CHAT_LIMIT = 4096
#: Characters of the longest question that is taken.
QUESTION_LIMIT = 500


def chat_html(text: Column, sources: Column, abstained: Column, closest: Column, product: str) -> Column:
    """A reply as chat HTML. sources: array<struct<label,url>>, closest: such a struct or null.

    Beyond CHAT_LIMIT characters the body is trimmed, never the sources.
    """
    link = lambda s: F.concat(F.lit('<a href="'), html_escape(s["url"]), F.lit('">'), html_escape(s["label"]), F.lit("</a>"))
    declined = F.concat_ws(
        "\n", F.concat(F.lit("🤷 "), html_escape(text)),
        F.when(closest.isNotNull(), F.concat(F.lit("\nClosest section I found: "), link(closest))),
        F.concat(F.lit("\n<i>I only answer from the "), html_escape(F.lit(product)), F.lit(" docs and won't guess.</i>")),
    )
    tail = F.concat(F.lit("\n\n<b>Sources</b>"), F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), link(s))), ""))
    body = html_escape(text)
    over = F.length(body) + F.length(tail) - CHAT_LIMIT
    shorter = F.substring(text, F.lit(1), F.greatest(F.lit(0), F.length(text) - over - 22))
    answered = F.when(over > 0, F.concat(html_escape(shorter), F.lit("…"), tail)).otherwise(F.concat(body, tail))
    return F.when(abstained, declined).otherwise(answered)


# ---- keys and small scalars ----


def user_hash(user: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), user.cast("string")), 256), 1, 16)


def embedding_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), text), 256)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 3) + 1


def retry_after(header: Column) -> Column:
    return header.try_cast("double")


#: What a judge is told of the expected behaviour.
EXPECTED_TEXT = {
    "answer": "answer the question",
    "abstain": "decline: the documentation does not answer this question",
    "correct_premise": "answer while explicitly correcting the question's false premise",
}


def expected_text(expected: Column) -> Column:
    pairs = [x for k, v in EXPECTED_TEXT.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), expected)


def percent_with_ci(value: Column, low: Column, high: Column) -> Column:
    """52.6 % [38.6, 64.9]; n/a for null and NaN."""
    shown = F.format_string("%.1f %% [%.1f, %.1f]", value * 100, low * 100, high * 100)
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(shown)

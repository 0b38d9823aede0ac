import pytest

from citemill.functions import markdown, markup
from citemill.functions.markup import normalize
from citemill.operators import chunking as C

W = C.count_words


def chunks(text, title=None, **cfg):
    return C.chunk_text(text, title, "doc", C.ChunkingConfig(**({"max_tokens": 20, "overlap_tokens": 0, "max_code_tokens": 30} | cfg)), W)


def test_blocks():
    text = "# A\n\nProse one\ngoes on\n\nSet\n---\n\n- a\n  - b\n\n  more\n- c\n\n1. x\n2. y\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```py\n# no heading\n\nx\n```\n\n> quote\nlazy\n\n***\n\n    code\n\n<div>\nhtml\n</div>\n"
    got = [(b.kind, b.text.split("\n")[0]) for b in markdown.parse(text)]
    assert got == [("heading", "A"), ("prose", "Prose one"), ("heading", "Set"), ("list", "- a"), ("list", "1. x"), ("table", "| h | i |"), ("code", "```py"), ("other", "> quote"), ("other", "***"), ("code", "    code"), ("other", "<div>")]
    assert [b.items for b in markdown.parse(text) if b.kind == "list"][0] == ["- a\n  - b\n\n  more", "- c"]


def test_heading_paths_and_title():
    got = chunks("# Guide\n\nintro\n\n## Sub\n\ntext\n\n### Deep\n\nmore\n\n## Other\n\nend\n", "Guide")
    assert [c["heading_path"] for c in got] == [["Guide"], ["Guide", "Sub"], ["Guide", "Sub", "Deep"], ["Guide", "Other"]]
    assert [c["chunk_id"] for c in got] == ["doc#000", "doc#001", "doc#002", "doc#003"]
    assert chunks("no heading")[0]["heading_path"] == ["doc"] and chunks("") == [] and chunks("# Only\n") == []


def test_code_is_never_cut_within_a_piece():
    code = "```js\n" + "\n\n".join(f"line{i} a b c d e f g" for i in range(10)) + "\n```"
    got = chunks(code)
    assert len(got) > 1 and all(c["text"].count("```") == 2 for c in got) and "(code block part 1/" in got[0]["text"]
    whole = "```\n" + "word " * 60 + "\n```"
    assert [c["text"] for c in chunks(whole)] == [whole]


def test_table_rows_all_appear_once_under_a_header():
    rows = [f"| r{i} | some value here |" for i in range(12)]
    got = chunks("\n".join(["| a | b |", "|---|---|", *rows]))
    assert len(got) > 1 and all(c["text"].startswith("| a | b |\n|---|---|\n") for c in got)
    assert [x for c in got for x in c["text"].split("\n")[2:]] == rows


def test_overlap_and_budget():
    text = " ".join(f"Sentence number {i} has six words." for i in range(12))
    plain, lapped = chunks(text), chunks(text, overlap_tokens=8)
    assert all(c["n_tokens"] <= 20 for c in plain + lapped)
    assert " ".join(c["text"] for c in plain) == text
    assert all(b["text"].startswith(a["text"].split(". ")[-1]) for a, b in zip(lapped, lapped[1:]))


def test_lead_in_stays_with_its_code():
    got = chunks("word " * 18 + "\n\nLike this:\n\n```\nx y z\n```")
    assert len(got) == 2 and got[1]["text"].startswith("Like this:\n\n```")


def test_lists_split_between_items():
    got = chunks("\n".join(f"- item {i} with a few words\n  - nested {i}" for i in range(6)))
    assert len(got) > 1 and all(c["text"].count("item") == c["text"].count("nested") for c in got)


def test_small_sections_merge():
    text = "# T\n\n## A\n\none two\n\n## B\n\nthree four\n\n# U\n\nfive six\n"
    got = chunks(text, min_section_tokens=10)
    assert [c["heading_path"] for c in got] == [["T"], ["U"]]
    assert got[0]["text"] == "**A**\n\none two\n\n**B**\n\nthree four"
    assert len(chunks(text)) == 3


def test_chunk_documents_and_native_packing(spark):
    df = spark.createDataFrame([("a", "a", None, "u", "s", "One two three. Four five six. Seven."), ("b", "b", None, "u", "s", None)], "doc_id string, slug string, title string, url string, source_url string, text string")
    assert [r.text for r in C.chunk_documents(df, C.ChunkingConfig(4, 0)).orderBy("ordinal").collect()] == ["One two three.", "Four five six. Seven."]
    assert [(r.doc_id, r.chunk, r.n_tokens, r.text) for r in C.pack_sentences(df, 4).orderBy("chunk").collect()] == [("a", 0, 3, "One two three."), ("a", 1, 4, "Four five six. Seven.")]


MDX = [
    ("---\ntitle: My Page\ndescription: 'All of it'\n---\nBody", "Body\n"),
    ('<Callout type="warn">\nCareful\n</Callout>', "**Warning:**\n\nCareful\n"),
    ('<Card\n  title="Pools"\n  href="/pools"\n  description="About"\n/>', "- **Pools**: About (/pools)\n"),
    ('<Tabs>\n<Tab value="npm">\n## Step 1\n</Tab>\n<Tab value="yarn">\n## Step 1\n</Tab>\n</Tabs>\n## Step 2', "## Step 1 (npm)\n\n## Step 1 (yarn)\n\n## Step 2\n"),
    ("```jsx\n<Card title='x' />\n{/* keep */}\n```\n{/* gone */}\nend", "```jsx\n<Card title='x' />\n{/* keep */}\n```\nend\n"),
    ("a {/* one\ntwo */} b", "a  b\n"),
    ("<details>\n<summary> More </summary>\ntext\n</details>", "**More**\ntext\n"),
    ("x\n```py\nopen", "x\n```py\nopen\n```\n"),
    ("a\r\n\r\n\r\n\r\nb", "a\n\nb\n"),
]


@pytest.mark.parametrize("source, want", MDX)
def test_markup(source, want):
    assert normalize(source)["text"] == want


def test_front_matter():
    got = normalize(MDX[0][0])
    assert (got["title"], got["description"]) == ("My Page", "All of it") and normalize(None)["title"] is None


def test_front_matter_is_yaml():
    block = "---\ntitle: 'A: b'\ntags: [x, y]\nnest:\n  k: 1\ndescription: |\n  two\n  lines\nday: 2024-01-02\n---\n# A: b\n"
    meta, body = markup.front_matter(block)
    assert (meta["title"], meta["tags"], meta["nest"], meta["description"]) == ("A: b", ["x", "y"], {"k": 1}, "two\nlines\n") and str(meta["day"]) == "2024-01-02" and body == "# A: b\n"
    assert markup.front_matter("---\n: : [\n---\nx") == ({}, "x") == markup.front_matter("---\n- a\n---\nx") == markup.front_matter("---\nday: 2024-13-45\n---\nx")
    assert markup.normalize("---\ntitle: [a]\ndescription: 7\n---\nx")["title"] is None and markup.normalize("---\ndescription: 7\n---\nx")["description"] == "7"


def test_sections_to_draft_from_count_words_outside_of_code(spark):
    words = "word " * 40
    source = f"---\ntitle: T\n---\n# T\n\n<Callout>\n{words}\n</Callout>\n\n- item {words}\n\n## Code\n\n```\n{words * 5}\n```\n\nFew words.\n\n## Long\n\n{words * 30}\n"
    rows = C.draftable(spark.createDataFrame([("d", source), ("e", None), ("f", "")], "doc_id string, source string")).orderBy("ordinal").collect()
    assert [(r.doc_id, r.heading_path) for r in rows] == [("d", ["T"]), ("d", ["T", "Long"])]
    assert rows[0].n_words >= 80 and rows[1].n_words == 1200 and len(rows[1].text.split(" ")) == 700 and "Callout" not in rows[0].text


@pytest.mark.parametrize("text, want", [
    ("> a\nlazy\n\nb", [("other", "> a\nlazy"), ("prose", "b")]),
    ("> # head\ntext", [("other", "> # head"), ("prose", "text")]),
    ("> ```\ncode\n```", [("other", "> ```"), ("prose", "code"), ("code", "```")]),
    ("> - item\nlazy\n> - other\n\n> apart", [("other", "> - item\nlazy\n> - other"), ("other", "> apart")]),
    ("- a\n\n      code in it\n\n  # head in it\n\nafter", [("list", "- a\n\n      code in it\n\n  # head in it"), ("prose", "after")]),
    ("- # head\ntext", [("list", "- # head"), ("prose", "text")]),
    ("- a\nlazy\n- b", [("list", "- a\nlazy\n- b")]),
    ("- ```\n  in\nout\n```", [("list", "- ```\n  in"), ("prose", "out"), ("code", "```")]),
    ("-\n\n  apart", [("list", "-"), ("prose", "  apart")]),
    ("-\n  within", [("list", "-\n  within")]),
    ("1. a\n2. b\n\n3) c", [("list", "1. a\n2. b"), ("list", "3) c")]),
    ("- a\n* b\n***\n- c", [("list", "- a"), ("list", "* b"), ("other", "***"), ("list", "- c")]),
    ("> > deep\n> lazy\nlazier", [("other", "> > deep\n> lazy\nlazier")]),
    ("1. > quoted in it\n   still\n\n   > more", [("list", "1. > quoted in it\n   still\n\n   > more")]),
    ("text\n2. no list\n1. a list", [("prose", "text\n2. no list"), ("list", "1. a list")]),
    ("-     five spaces\n\n      code", [("list", "-     five spaces\n\n      code")]),
    ("<b>bold</b> text\nmore", [("prose", "<b>bold</b> text\nmore")]),
    ("<https://x.example> is it", [("prose", "<https://x.example> is it")]),
    ("<Tag a=1 b='2'>\nshown\n\ntext", [("other", "<Tag a=1 b='2'>\nshown"), ("prose", "text")]),
    ("text\n<Tag>\nmore", [("prose", "text\n<Tag>\nmore")]),
    ("text\n<div>\nmore\n\nend", [("prose", "text"), ("other", "<div>\nmore"), ("prose", "end")]),
    ("<!-- a\n\n# no head -->\n# head", [("other", "<!-- a\n\n# no head -->"), ("heading", "head")]),
    ("<script>\n\nlet a\n</script>\nb", [("other", "<script>\n\nlet a\n</script>"), ("prose", "b")]),
    ("``` no `fence\ntext", [("prose", "``` no `fence\ntext")]),
    ("~~~ `a`\n# x\n~~~", [("code", "~~~ `a`\n# x\n~~~")]),
    ("    code\n\n    more\ntext", [("code", "    code\n\n    more"), ("prose", "text")]),
    ("text\n    no code\nHead\n===", [("heading", "text no code Head")]),
    ("> a\n---", [("other", "> a"), ("other", "---")]),
    ("a | b\n- | -\n1 | 2\n> q", [("table", "a | b\n- | -\n1 | 2"), ("other", "> q")]),
    ("\ta tab of code", [("code", "\ta tab of code")]),
])
def test_containers_hold_their_blocks(text, want):
    assert [(b.kind, b.text) for b in markdown.parse(text)] == want


def test_items_of_lists_that_hold_blocks():
    block = markdown.parse("1. a\n\n   ```\n   # no head\n   ```\n2. b\n   - c\n     - d\n\n   e\nlazy")[0]
    assert block.items == ["1. a\n\n   ```\n   # no head\n   ```", "2. b\n   - c\n     - d\n\n   e\nlazy"]


def test_parsing_takes_linear_time():
    import time

    for text in ("> a\nb\n" * 40_000, "- " * 30_000, "> " * 3000 + "\n" + "x\n" * 3000, "- a\n\n      ```\n" * 20_000, "<a " * 50_000, "[" * 50_000):
        t = time.perf_counter()
        markdown.parse(text)
        assert time.perf_counter() - t < 10

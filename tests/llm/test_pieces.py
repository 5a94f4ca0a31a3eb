import random

import pytest
from tokenizers import Tokenizer

from stemline.llm.bpe import VOCABULARY
from stemline.llm.pieces import KINDS, fenced, marks, split_oversized

PUBLIC = Tokenizer.from_file(VOCABULARY)
PUBLIC.encode_special_tokens = True


def ids(text):
    return PUBLIC.encode(text or "", add_special_tokens=False).ids


def prose(seed, paragraphs):
    rnd = random.Random(seed)
    sentence = lambda: " ".join(rnd.choice(["cell", "nucleus", "frame", "track", "divides"]) for _ in range(rnd.randrange(3, 14))) + "."
    return "\n\n".join(" ".join(sentence() for _ in range(rnd.randrange(1, 6))) for _ in range(paragraphs))


TEXTS = [
    prose(1, 40),
    "# One\n" + prose(2, 12) + "\n## Two\n" + prose(3, 12) + "\n```python\nx = 1\n```\n" + prose(4, 3),
    "x" * 4000,
    "日本語の文章です。" * 80,
    "🧬" * 500,
    prose(5, 1),
    "",
    None,
    "a b " * 600,
    " \n" * 900,
]


@pytest.mark.parametrize("limit,overlap", [(100, 10), (64, 0), (300, 64)])
def test_pieces(spark, limit, overlap):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, piece string")
    rows = split_oversized(docs, limit, overlap).collect()
    assert {r.doc_id for r in rows} == {i for i, t in enumerate(TEXTS) if len(ids(t)) > limit}
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        if not own:
            continue
        assert [r.piece for r in own] == list(range(len(own)))
        rebuilt = list(own[0].ids)
        for before, r in zip(own, own[1:]):
            assert r.ids[:overlap] == before.ids[len(before.ids) - overlap :] and r.start_token == before.start_token + before.n_tokens - overlap
            rebuilt += r.ids[overlap:]
        assert rebuilt == ids(text)  # an exact round trip
        assert all(len(r.ids) == r.n_tokens <= limit for r in own)
        assert own[-1].ends_at == "end" and text.startswith(own[0].text) and text.endswith(own[-1].text)


def test_ends_at_natural_boundaries(spark):
    docs = spark.createDataFrame([(0, TEXTS[0]), (1, TEXTS[1]), (2, TEXTS[2])], "doc_id long, text string")
    rows = split_oversized(docs, 150, 20).collect()
    for r in rows:
        if r.doc_id == 0 and r.ends_at != "end":
            assert r.ends_at == "paragraph" and r.text.endswith("\n\n")
    assert {r.ends_at for r in rows if r.doc_id == 2} == {"character", "end"}
    heads = "\n".join(f"# Part {k}\n{prose(10 + k, 12)}" for k in range(5))
    whole = split_oversized(spark.createDataFrame([(1, heads)], "doc_id long, text string"), 500, 20).collect()
    assert "section" in {r.ends_at for r in whole} and len(whole) > 2


def kinds_of(text):
    place, kind = marks(text)
    return {text[a:].split("\n")[0][:12]: KINDS[k] for a, k in zip(place, kind)}


def test_code_is_told_before_headings():
    text = "Intro text.\n\n```python\n# step one\n\nx = 1. And\n# step two\ny = 2\n```\nAfter it.\n# Real heading\nLast."
    got = kinds_of(text)
    assert got["```python"] == "paragraph" and got["After it."] == "paragraph" and got["# Real headi"] == "section"
    assert got["# step one"] == got["x = 1. And"] == got["# step two"] == got["y = 2"] == "line" and " And" not in got


def test_code_in_other_notations_and_unclosed_fences():
    lines = ["a", "", "    # indented", "", "    more", "", "text", "<pre>", "# x", "</pre>", "end", "~~~", "# not closed", "```", "```"]
    assert fenced(lines).tolist() == [0, 0, 3, 3, 3, 0, 0, 2, 2, 2, 0, 0, 0, 1, 1]
    assert kinds_of("\n".join(lines))["# not closed"] == "section"


def test_a_title_stays_with_its_underline():
    got = kinds_of("Before.\n\nTitle\n-----\nText.\n\n---\nMore.\n# H\n---\nx")
    assert got["Title"] == "section" and got["-----"] == "word" and got["---"] == "section" and got["More."] == "line"


def test_large_code_is_cut_between_lines(spark):
    code = "```python\n" + "\n\n".join(f"# step {k}\nvalue_{k} = compute({k})" for k in range(120)) + "\n```\n"
    text = prose(6, 3) + "\n\n" + code + prose(7, 3)
    rows = split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), 200, 20).collect()
    inside = [r for r in rows if "# step" in r.text and r.ends_at != "end"]
    assert len(inside) > 4 and {r.ends_at for r in inside} <= {"line", "paragraph"} and all(r.text.endswith("\n") for r in inside)


def test_empty_table(spark):
    assert split_oversized(spark.createDataFrame([], "doc_id long, text string")).count() == 0

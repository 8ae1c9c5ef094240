"""The structure-aware chunker and the measured overlap, against plain loops written from the rule."""

from __future__ import annotations

import math
import random
import re

import pytest

from scrivener import registry
from scrivener.functions import chunks as C
from scrivener.functions import tables as T

TOKEN = re.compile(r"[㐀-䶿一-鿿]|[A-Za-z0-9]+(?:[+._/\-][A-Za-z0-9]+)*|[^\s]")
WORDS = "alpha Beta gamma-delta x 中文 epsilon.zeta 42 ! interoperability".split()


def size(text: str) -> int:
    return sum(math.ceil(len(t) / 4) if t[0].isascii() and t[0].isalnum() else 1 for t in TOKEN.findall(text))


def plain_shared(a: str, b: str, most: int) -> int:
    x, y = TOKEN.findall(a), TOKEN.findall(b)
    return max((k for k in range(1, min(len(x), len(y), most) + 1) if x[-k:] == y[:k]), default=0)


def plain_chunks(texts: list[str], target: int, most: int, overlap: int) -> list[str]:
    """Each step looks at the whole text of the chunk so far."""
    chunks, units = [], []
    for unit in texts:
        here = "\n\n".join(units)
        if units and (size(here) >= target or size("\n\n".join([*units, unit])) > most):
            chunks.append(here)
            keep = max(k for k in range(len(units) + 1) if size("\n\n".join(units[len(units) - k :])) <= overlap)
            carried = units[len(units) - keep :] if keep else T.hard_split(units[-1], overlap)[-1:] if overlap else []
            while carried and size("\n\n".join([*carried, unit])) > most:
                carried = carried[1:]
            units = carried
        units = [*units, unit]
    return [*chunks, "\n\n".join(units)] if units else chunks


def text_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "。"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(5))
def test_chunks_of_an_island(seed):
    rng = random.Random(seed)
    for _ in range(80):
        target, most, overlap = rng.randint(4, 25), rng.randint(25, 50), rng.choice([0, 3, 9, 14])
        texts = C.units(text_of(rng, rng.randint(0, 150)), most)
        assert all(size(t) <= most for t in texts)
        got = ["\n\n".join(t for t, _ in held) for held in C.packed(texts, target, most, overlap)]
        assert got == plain_chunks(texts, target, most, overlap)
        assert all(size(g) <= most for g in got)


def test_units_fill_sentences_up():
    assert C.units("One two. Three four. Five six seven eight nine.\n\nshort", 8) == ["One two. Three four.", "Five six seven eight nine.", "short"]
    assert C.units("a" * 100, 5) == ["a" * 20] * 5
    assert C.units("", 5) == C.units(" \n\n ", 5) == []


def test_measured_overlap(spark):
    rng = random.Random(1)
    pairs = [(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 12))), " ".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))) for _ in range(300)] + [("a b c", "b c d"), ("", "a"), ("a", "")]
    for a, b in pairs:
        assert C.shared(C.tokens(a), C.tokens(b), 7) == plain_shared(a, b, 7)
    rows = [(i, j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    got = C.with_overlaps(spark.createDataFrame(rows, "k int, j int, t string"), "k", "j", "t", 7).collect()
    assert {(r["k"], r["j"]): r["shared"] for r in got} == {(i, j): plain_shared(*pairs[i], 7) if j else 0 for i in range(len(pairs)) for j in (0, 1)}


def test_islands_structures_and_continuity(spark):
    long = "\n\n".join(f"Sentence number {i} of this prose is here." for i in range(60))
    rows = [
        (1, 0, "# A\n\nfirst line\r\n\r\n\r\nsecond  \n", "A", "about A", "prose", None), (1, 1, "third", "A", "about A", None, ""), (1, 2, long, "A > B", "on  B", "prose", None),
        (1, 3, "1: step\n2: step", "A > B", "", "algorithm", "s1"), (1, 4, "\n\n".join(f"{i}: a longer step of it" for i in range(3, 60)), "A > B", "", "algorithm", "s1"),
        (1, 5, "after", "A > B", "late", "prose", None), (1, 6, "   ", "A", "", "prose", None), (1, 7, "## B\n# A\nend", "A > B", "late", "prose", None), (2, 0, "no heading", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc int, ordinal int, content string, path string, summary string, kind string, structure string")
    got = [r.asDict() for r in C.structured_chunks(df, "doc", 100, 140, 20).orderBy("doc", "chunk").collect()]
    first = got[0]
    assert (first["content"], first["section"], first["blocks"], first["summary"], first["overlap_tokens"]) == ("first line\n\nsecond\n\nthird", "A", [0, 1], "about A", 0)
    prose = [r for r in got if r["blocks"] == [2]]
    assert len(prose) > 3 and all(r["overlap_tokens"] > 0 for r in prose[1:]) and prose[0]["overlap_tokens"] == 0 and all(r["summary"] == "on B" for r in prose)
    assert [r["overlap_tokens"] for r in prose] == [0, *(plain_shared(a["content"], b["content"], 20) for a, b in zip(prose, prose[1:]))]
    steps = [r for r in got if r["structure"] == "s1"]
    assert len(steps) > 2 and all(r["overlap_tokens"] == 0 for r in steps) and [r["sequence"] for r in steps] == list(range(len(steps)))
    assert [r["continues_to"] for r in steps] == [f"s1:{i}" for i in range(1, len(steps))] + [None] and steps[1]["continues_from"] == "s1:0" and steps[0]["is_start"] and steps[-1]["is_end"] and not steps[1]["is_end"]
    assert got[-2]["content"] == "after\n\nend" and got[-2]["summary"] == "late" and got[-2]["blocks"] == [5, 7] and got[-2]["sequence"] is None
    assert (got[-1]["doc"], got[-1]["section"], got[-1]["content"]) == (2, "正文", "no heading")
    assert [r["chunk"] for r in got[:-1]] == list(range(len(got) - 1)) and all(r["tokens"] == size(r["content"]) <= 140 for r in got)
    assert C.structured_chunks(df.limit(0), "doc").count() == 0


def test_overlap_of_the_whole_table_equals_the_plain_loop(spark, sf_dir):
    chunks = T.token_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id", "text").orderBy("doc_id", "chunk").collect()
    want = {(b["doc_id"], b["chunk"]): plain_shared(a["content"], b["content"], 80) if a["doc_id"] == b["doc_id"] else 0 for a, b in zip([chunks[-1], *chunks], chunks)}
    got = registry.queries()["chunk_overlaps"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["chunk"]): r["shared"] for r in got} == want and all(r["shared"] >= min(r["carried"], 1) for r in got)


def test_units_that_repeat_are_counted_once(spark):
    # A tail that equals the units behind it isn't taken for them.
    rows = [(d, i, "same words here" if d == 1 else f"{'x y z' if i % 3 else 'a b'}") for d in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc int, ordinal int, content string").selectExpr("*", "'' AS path", "'' AS summary", "'' AS kind", "'' AS structure")
    got = [r.asDict() for r in C.structured_chunks(df, "doc", 10, 14, 6).orderBy("doc", "chunk").collect()]
    for doc in (1, 2):
        blocks = [r["blocks"] for r in got if r["doc"] == doc]
        assert sorted({n for b in blocks for n in b}) == list(range(60)) and all(a[0] < b[0] and a[-1] < b[-1] for a, b in zip(blocks, blocks[1:]))
        assert all(r["content"] == "\n\n".join(c for d, n, c in rows if d == doc and n in r["blocks"]) for r in got if r["doc"] == doc)

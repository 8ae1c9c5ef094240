"""Sections and pieces of documents, against plain loops written from the rule."""

from __future__ import annotations

import random
import re

import pytest

from scrivener import registry
from scrivener.functions import splitter as S

FILL = "Plain words fill this paper until it is long enough. "


def test_headings_of_plain_text_only_in_long_texts_without_markdown():
    text = "My Title\nA. Author\nAbstract: we do it.\n1 Introduction\nprose here\n2.1\n\nDeep Learning Part\nmore\n3 this is no title at all\nMethods\n" + FILL * 50 + "\nReferences\n[1] A\nhttp://x.org\nAppendix\nlast"
    found = S.categorised(S.sections_of(text))
    assert [(s.headings[0] if s.headings else None, s.category) for s in found] == [
        (None, "front_matter"), ((2, "Abstract"), "body"), ((2, "1 Introduction"), "body"), ((3, "2.1 Deep Learning Part"), "body"), ((2, "Methods"), "body"), ((2, "References"), "references"), ((2, "Appendix"), "back_matter"),
    ]
    assert found[1].text == "## Abstract\nwe do it." and found[3].text == "### 2.1 Deep Learning Part\nmore\n3 this is no title at all"
    assert len(S.sections_of(text[:300])) == 1  # too short
    assert [s.headings for s in S.sections_of("# A\n## B\n" + text)] == [((1, "A"),), ((2, "B"),)]  # two Markdown headings


def test_categories():
    of = lambda *names: [s.category for s in S.categorised(S.sections_of("\n".join(f"# {n}\ntext" for n in names)))]
    assert of("Paper", "Authors", "1. Introduction", "2 Method", "References", "A.1 Proof", "Funding", "Other") == ["front_matter", "front_matter", "body", "body", "references", "references", "back_matter", "body"]
    assert of("Corresponding Authors", "Body", "致谢", "参考文献", "more") == ["front_matter", "body", "back_matter", "references", "references"]


def test_structures_and_hard_cuts():
    table = "\n".join(["| a | b |", "|---|---|", *(f"| {i} | {i} |" for i in range(30))])
    text = f"before $$x$$ after\n\n```py\ncode $$y$$\n```\n\n{table}\n\nend"
    found = S.pieces_of(S.Section(((1, "H"),), 1, text), 100, False)
    assert [p.kind for p in found if p.kind != "table"] == ["prose", "equation", "prose", "code", "prose"]
    tables = [p for p in found if p.kind == "table"]
    assert len(tables) > 3 and len({p.structure for p in tables}) == 1 and all(len(p.text) <= 100 for p in tables) and "\n".join(p.text for p in tables) == table
    assert [p.part for p in found] == list(range(1, len(found) + 1)) and found[0].parts == len(found)
    assert S.hard_split("aaaa bbbb cccc", 10) == ["aaaa bbbb", "cccc"] and S.hard_split("a bbbbbbbbbbbbb", 10) == ["a bbbbbbbb", "bbbbb"] and S.hard_split("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert S.prose("One two. Three four. Five", 16) == ["One two.", "Three four.Five"]


def plain_pieces(sections: list[tuple[int | None, str, bool]], least: int, most: int) -> list[tuple[str, bool]]:
    """Texts of sections (level, text, whole) after both merges and the buffer, each marked if it is kept whole. Every text fits."""
    join = lambda *x: "\n\n".join(x)
    first = []
    for level, text, whole in sections:
        if first and not whole and not first[-1][2] and len(text) < least and (level is None or first[-1][0] is None or level == first[-1][0]) and len(join(first[-1][1], text)) <= most:
            first[-1] = (first[-1][0] if first[-1][0] is not None else level, join(first[-1][1], text), False)
        else:
            first.append((level, text, whole))
    out, wait = [], []
    for _, text, whole in first:
        if whole:
            out += [(join(*wait), False)] if wait else []
            out, wait = [*out, (text, True)], []
        elif len(text) < least:
            wait.append(text)
            if len(join(*wait)) >= least:
                out, wait = [*out, (join(*wait), False)], []
        elif wait and len(join(*wait, text)) <= most:
            out, wait = [*out, (join(*wait, text), False)], []
        else:
            out += [(join(*wait), False)] if wait else []
            out, wait = [*out, (text, False)], []
    if wait and out and len(join(out[-1][0], *wait)) <= most:
        out[-1] = (join(out[-1][0], *wait), False)
    elif wait:
        out.append((join(*wait), False))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_buffer_of_small_sections(seed):
    rng = random.Random(seed)
    for _ in range(300):
        least, most = rng.randint(10, 40), rng.randint(85, 140)
        spec = []
        for _ in range(rng.randint(0, 9)):
            level = rng.choice([1, 2])
            body = "w" * rng.choice([1, 5, 15, 30, 50])
            name = rng.choice(["Part", "Part", "Part", "Funding"])
            spec.append((level, f"{'#' * level} {name}\n{body}", name == "Funding"))
        spec = [(None, "lead", False), *spec] if rng.random() < 0.3 else spec
        text = "\n".join(["## Abstract\nx", *(t for _, t, _ in spec if not t.startswith("lead"))])
        want_in = [(2, "## Abstract\nx", False), *(s for s in spec if s[1] != "lead")]
        grouped = []
        for s in want_in:
            if s[2] and grouped and grouped[-1][2]:
                grouped[-1] = (grouped[-1][0], grouped[-1][1] + "\n\n" + s[1], True)
            else:
                grouped.append(s)
        got = S.split_document(text, least, most)
        assert [p.text for p in got] == [t for t, _ in plain_pieces(grouped, least, most)]


def test_whole_table_loses_nothing(spark, sf_dir):
    rows = registry.queries()["section_pieces"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    by_doc: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    bare = lambda t: re.sub(r"[#\s]", "", t)
    for d, text in docs.items():
        assert "".join(bare(r["content"]) for r in by_doc.get(d, [])) == bare(text or "")
        assert all(len(r["content"]) <= 1600 or r["category"] in S.WHOLE for r in by_doc.get(d, []))
    assert S.split_document("") == S.split_document(" \n ") == []
    with pytest.raises(ValueError):
        S.split_document("x", 10, 5)

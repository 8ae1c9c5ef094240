"""Section splitting of plain text and Markdown: headings, categories, semantic units, size-driven merges.

These fold over one document's lines, which a task holds one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from scrivener.functions.tables import SENTENCE, _per_text

FENCE, ATX = re.compile(r"^\s{0,3}(```|~~~)"), re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")
NUMBERED, NUMBER = re.compile(r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+(\S.{1,98})$"), re.compile(r"^(\d{1,2}(?:\.\d{1,2}){0,3})\.?$")
# Headings that stand without a number, and the categories of sections, of this plain splitter; splitter.py has the full ones.
COMMON = ("abstract", "introduction", "background", "related work", "methods", "method", "results", "discussion", "conclusion", "conclusions", "acknowledgements", "acknowledgments", "references", "bibliography", "appendix")
CATEGORIES = (
    ("references", ("references", "bibliography", "参考文献")), ("abstract", ("abstract", "摘要")), ("introduction", ("introduction", "引言")),
    ("back_matter", ("acknowledg", "funding", "conflict of interest", "author contributions", "appendix", "致谢")), ("method", ("method", "approach", "方法")),
    ("result", ("result", "experiment", "evaluation", "结果", "实验")), ("conclusion", ("conclusion", "discussion", "结论")),
)
WHOLE = ("front_matter", "abstract", "references")
#: Kinds of semantic units and how they look, the outermost first.
UNITS = (
    ("code", re.compile(r"(?ms)^\s{0,3}(```|~~~).*?^\s{0,3}\1[^\n]*$")), ("equation", re.compile(r"(?s)\$\$.+?\$\$|\\begin\{(?:equation|align)\*?\}.+?\\end\{(?:equation|align)\*?\}")),
    ("table", re.compile(r"(?m)(?:^\s*\|.*\|[ \t]*(?:\n|\Z)){2,}")), ("algorithm", re.compile(r"(?m)(?:^\s*\d{1,3}:\s.*(?:\n|\Z)){3,}")),
)


@dataclass(frozen=True)
class Section:
    level: int
    heading: str
    line: int
    content: str
    category: str = ""


def title_like(text: str) -> bool:
    """Six of ten words, or more, start with a capital."""
    words = [w for w in re.findall(r"[^\W\d_]+", text) if len(w) > 3]
    return bool(words) and sum(w[0].isupper() for w in words) >= 0.6 * len(words)


def plain_heading(lines: list[str], at: int) -> tuple[int, str, int] | None:
    """Level, heading and lines that it takes, if a line of plain text is a heading."""
    line = lines[at].strip()
    if not line or len(line) > 100:
        return None
    if m := NUMBERED.match(line):
        if title_like(m[2]) and line[-1] not in ".,;":
            return m[1].count(".") + 1, line, 1
    if m := NUMBER.match(line):  # the number alone, its title one or two lines below
        for k in range(at + 1, min(at + 3, len(lines))):
            if below := lines[k].strip():
                return (m[1].count(".") + 1, f"{m[1]} {below}", k - at + 1) if len(below) <= 98 and title_like(below) else None
        return None
    if line.lower().rstrip(":") in COMMON:
        return 1, line.rstrip(":"), 1
    if m := re.match(r"(?i)^(abstract|摘要)\s*[—:.\-]\s*(?=\S)", line):
        return 1, m[1], 0  # the rest of the line is its text
    return None


def sections_of(text: str) -> list[Section]:
    """Sections in order; the first has no heading where text stands before it. No heading is seen in a code fence."""
    lines, out, fenced, at = text.replace("\r\n", "\n").split("\n"), [], False, 0
    heads: list[tuple[int, int, str, int]] = []  # line, level, heading, lines taken
    while at < len(lines):
        if FENCE.match(lines[at]):
            fenced = not fenced
        elif not fenced:
            m = ATX.match(lines[at])
            if found := (len(m[1]), m[2], 1) if m else plain_heading(lines, at):
                heads.append((at, *found))
                at += max(1, found[2])
                continue
        at += 1
    marks = [(-1, 0, "", 1), *heads, (len(lines), 0, "", 0)]
    for (line, level, heading, taken), (stop, *_) in zip(marks, marks[1:]):
        content = "\n".join(lines[line + taken if line >= 0 else 0 : stop]).strip()
        if heading or content:
            out.append(Section(level, heading, max(1, line + 1), content))
    return out


def categorised(sections: list[Section]) -> list[Section]:
    """Categories by heading; front matter stands before the abstract or introduction; what is below references belongs
    to them until a heading of their level or above that has a category of its own."""
    out, sticky = [], None
    named = [next((c for c, words in CATEGORIES if any(w in s.heading.lower() for w in words)), "") for s in sections]
    start = next((i for i, c in enumerate(named) if c in ("abstract", "introduction")), 0)
    for i, (s, category) in enumerate(zip(sections, named, strict=True)):
        if sticky is not None and not (category and category != "references" and s.level <= sticky):
            category = "references"
        else:
            sticky = s.level if category == "references" else None
        out.append(replace(s, category="front_matter" if i < start else category or "body"))
    return out


def kept_whole(sections: list[Section]) -> list[Section]:
    """Neighbours of one category that is kept whole, as one section under the first one's heading."""
    out: list[Section] = []
    for s in sections:
        if out and s.category in WHOLE and out[-1].category == s.category:
            inner = "\n\n".join(x for x in (out[-1].content, s.heading, s.content) if x)
            out[-1] = replace(out[-1], content=inner)
        else:
            out.append(s)
    return out


def units_of(text: str) -> list[tuple[str, str]]:
    """Kind and text of semantic units, prose between them included; the outermost of units within each other counts."""
    spans = sorted(((m.start(), -m.end(), kind) for kind, p in UNITS for m in p.finditer(text)))
    out, at = [], 0
    for start, stop, kind in spans:
        if start < at:
            continue
        out += [("prose", text[at:start]), (kind, text[start:-stop])]
        at = -stop
    return [(k, t.strip("\n")) for k, t in [*out, ("prose", text[at:])] if t.strip()]


def split_lines(text: str, most: int) -> list[str]:
    """Parts of whole lines, of `most` characters or one line each."""
    out, here = [], ""
    for line in text.split("\n"):
        joined = f"{here}\n{line}" if here else line
        if here and len(joined) > most:
            out.append(here)
            here = line
        else:
            here = joined
    return [*out, here]


def split_prose(text: str, most: int) -> list[str]:
    """Parts of at most `most` characters, at paragraph ends, else sentence ends, else anywhere."""
    out, here = [], ""
    for paragraph in re.split(r"\n\s*\n", text):
        pieces = [paragraph] if len(paragraph) <= most else [s[i : i + most] for s in SENTENCE.findall(paragraph) for i in range(0, len(s), most)]
        for k, piece in enumerate(pieces):
            glue = "\n\n" if k == 0 else ""
            if here and len(here) + len(glue) + len(piece) > most:
                out.append(here.strip())
                here = piece
            else:
                here = here + glue + piece if here else piece
    return [p for p in [*out, here.strip()] if p]


def merged(sections: list[Section], least: int, most: int) -> list[Section]:
    """Sections below `least` characters join the one before, if it has their level and both fit into `most`; a small one
    at the end joins whatever is before it, if they fit."""
    out: list[Section] = []
    for s in sections:
        before = out[-1] if out else None
        small = before and (len(s.content) < least or len(before.content) < least)
        if small and before.level == s.level and before.category == s.category and len(before.content) + len(s.heading) + len(s.content) + 4 <= most:
            out[-1] = replace(before, content="\n\n".join(x for x in (before.content, s.heading, s.content) if x))
        else:
            out.append(s)
    if len(out) > 1 and len(out[-1].content) < least and len(out[-2].content) + len(out[-1].content) + len(out[-1].heading) + 4 <= most and out[-1].category == out[-2].category:
        s = out.pop()
        out[-1] = replace(out[-1], content="\n\n".join(x for x in (out[-1].content, s.heading, s.content) if x))
    return out


def split_document(text: str, least: int = 800, most: int = 1600) -> Iterator[tuple[str, int, str, str, int, int, str]]:
    """Heading, level, category, kind, part, parts and text of every piece of a document."""
    for s in merged(kept_whole(categorised(sections_of(text))), least, most):
        if s.category in WHOLE or len(s.content) <= most:
            pieces = [("section", s.content)]
        else:
            pieces = [(k, p) for k, t in units_of(s.content) for p in (split_prose(t, most) if k == "prose" else split_lines(t, most))]
        for i, (kind, piece) in enumerate(pieces):
            yield s.heading, s.level, s.category, kind, i + 1, len(pieces), piece


def document_pieces(df: DataFrame, key: str, text: str, least: int = 800, most: int = 1600) -> DataFrame:
    """key, piece, heading, level, category, kind, part, parts and content. Null and empty texts give no rows."""
    schema = "piece int, heading string, level int, category string, kind string, part int, parts int, content string"
    return _per_text(df, key, text, schema, lambda t: ((i, *p) for i, p in enumerate(split_document(t, least, most))))


def normalized(text: str) -> str:
    """Line ends as \\n, no blanks at line ends, and one empty line for several, but for what is in code fences."""
    out, fenced = [], False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        fence = bool(FENCE.match(line))
        line = line if fenced and not fence else line.rstrip()
        if not (not fenced and line == "" and out and out[-1] == ""):
            out.append(line)
        fenced ^= fence
    return "\n".join(out).strip("\n")


def normalize_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    return _per_text(df, key, text, "content string", lambda t: [(normalized(t),)])

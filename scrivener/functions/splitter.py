"""Documents to sections and retrieval pieces: headings, categories, a buffer of small sections, structures kept apart.

A section is read from Markdown headings; in a long text that has hardly any, headings of plain text are recognised too.
Front matter, references and back matter stay whole. Of the rest, sections that are too small wait in a buffer until they
are large enough together or join what follows; what waits at the end joins the last piece, if both fit. Long sections are
cut at structures (algorithms, tables, code, equations), paragraphs, sentences and, at last, blanks.

These fold over one document's lines, which a task holds one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from scrivener.functions.tables import _per_text

# Headings by category, in lower case, and headings that plain text has without a number.
ABSTRACT = {"abstract", "summary", "摘要", "摘 要", "内容摘要", "executive summary"}
INTRODUCTION = {"introduction", "intro", "background", "overview", "引言", "前言", "简介", "概述", "背景"}
FRONT_MATTER = {
    "title", "authors", "author", "author information", "author details", "affiliations", "affiliation", "correspondence", "corresponding author",
    "address", "addresses", "postal address", "contact information", "keywords", "keywords and phrases", "running title",
    "作者", "作者信息", "作者简介", "单位", "机构", "所在单位", "通讯作者", "通讯地址", "地址", "邮编", "邮政编码", "关键词",
}
FRONT_MATTER_PARTS = {"author", "affiliation", "address", "correspond", "作者", "单位", "通讯", "地址", "邮编"}
REFERENCES = {"references", "reference", "bibliography", "works cited", "literature cited", "参考文献", "参考资料", "引用文献"}
BACK_MATTER = {
    "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "funding", "funding statement", "funding information",
    "conflict of interest", "conflicts of interest", "competing interests", "declaration of interests", "declarations", "author contributions",
    "authors' contributions", "credit authorship contribution statement", "ethics statement", "ethics approval",
    "ethics approval and consent to participate", "data availability", "data availability statement", "availability of data and materials",
    "supplementary material", "supplementary materials", "appendix", "appendices", "supporting information",
    "附录", "致谢", "基金", "基金支持", "项目资助", "利益冲突", "作者贡献", "伦理声明", "数据可用性", "补充材料",
}
OTHER_SECTIONS = {
    "related work", "related works", "preliminaries", "preliminary", "method", "methods", "methodology", "materials and methods", "technical overview",
    "implementation", "experimental setup", "experimental results", "experiments", "evaluation", "results", "discussion", "conclusion", "conclusions",
    "limitations", "security analysis", "security estimation",
    "相关工作", "预备知识", "方法", "实验设置", "实验结果", "实验", "评估", "结果", "讨论", "结论", "局限性", "安全性分析",
}
SMALL_WORDS = {"a", "an", "and", "for", "in", "of", "on", "the", "to", "with"}
COMMON = ABSTRACT | INTRODUCTION | REFERENCES | BACK_MATTER | OTHER_SECTIONS
WHOLE = ("front_matter", "references", "back_matter")
# Fixed patterns of headings and, but for the last, of structures.
ATX = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
NUMBERED, NUMBER = re.compile(r"^(\d{1,2}(?:\.\d{1,3}){0,4})\s+(.+?)\s*$"), re.compile(r"^\d{1,2}(?:\.\d{1,3}){0,4}$")
ABSTRACT_LINE = re.compile(r"^(abstract|summary|摘要)\s*[.:：]\s*(.+)$", re.I)
STRUCTURES = (
    ("algorithm", re.compile(r"<div\b[^>]*class=[\"'][^\"']*(?:algorithm|pseudocode)[^\"']*[\"'][^>]*>.*?</div>", re.I | re.S)),
    ("table", re.compile(r"<table\b[^>]*>.*?</table>", re.I | re.S)),
    ("code", re.compile(r"```[^\n]*\n.*?```", re.S)),
    ("equation", re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]", re.S)),
    ("table", re.compile(r"(?m)^[ \t]*\|.*\|[ \t]*\n[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$(?:\n[ \t]*\|.*\|[ \t]*$)+")),  # all rows of a table
)
SENTENCES = re.compile(r".+?(?:[.!?。！？；;](?=\s|$)|$)", re.S)
FEW_HEADINGS, LONG_TEXT, LONGEST_TITLE, MOST_TITLE_WORDS, LONGEST_CHINESE_TITLE = 1, 2000, 120, 16, 40


@dataclass(frozen=True)
class Section:
    """headings: (level, heading) of all sections that it was made of; the text has them too."""

    headings: tuple[tuple[int, str], ...]
    line: int
    text: str
    category: str = "body"

    def __add__(self, other: Section) -> Section:
        new = tuple(h for h in other.headings if h not in self.headings)
        return replace(self, headings=self.headings + new, text=both(self.text, other.text))


@dataclass(frozen=True)
class Piece:
    headings: tuple[tuple[int, str], ...]
    category: str
    kind: str
    structure: str
    part: int
    parts: int
    text: str


def both(a: str, b: str) -> str:
    return "\n\n".join(x for x in (a.strip(), b.strip()) if x)


def heading_key(heading: str) -> str:
    """A heading in lower case, without its number and with single blanks."""
    return " ".join(re.sub(r"^[\d.\-()\[\]\s]+", "", heading.strip().lower()).split())


def title_like(text: str) -> bool:
    """Whether a line of plain text looks like a title: short, no address and no sentence, known or mostly capitalised."""
    text = text.strip()
    if not 0 < len(text) <= LONGEST_TITLE or len(text.split()) > MOST_TITLE_WORDS or re.search(r"(?i)https?://|@|[,;；。！？!?]$", text):
        return False
    if heading_key(text) in COMMON:
        return True
    if re.search("[一-鿿]", text):
        return len(text) <= LONGEST_CHINESE_TITLE and not re.search("[。！？；]", text)
    words = [w for w in re.findall(r"[A-Za-z][A-Za-z'\-]*", text) if w.casefold() not in SMALL_WORDS]
    return bool(words) and sum(w[0].isupper() for w in words) / len(words) >= 0.6


def plain_heading(lines: list[str], at: int) -> tuple[int, str, int, str] | None:
    """Level, heading, lines that it takes, and what of its line is text, if a line of plain text is a heading."""
    line = lines[at].strip()
    if not line or line.startswith("#"):
        return None
    if m := ABSTRACT_LINE.match(line):
        return 2, m[1].title(), 1, m[2].strip()
    level = min(6, 2 + line.partition(" ")[0].count("."))
    if (m := NUMBERED.match(line)) and title_like(m[2]):
        return min(6, 2 + m[1].count(".")), f"{m[1]} {m[2].strip()}", 1, ""
    if NUMBER.match(line):
        below = next((k for k in range(at + 1, min(at + 3, len(lines))) if lines[k].strip()), None)
        if below is not None and title_like(lines[below]):
            return level, f"{line} {lines[below].strip()}", below - at + 1, ""
    return (2, line, 1, "") if heading_key(line) in COMMON else None


def sections_of(text: str) -> list[Section]:
    """Sections in order, each with its heading as the first line of its text; the first has none where text stands before
    any heading. Headings of plain text count only where a text of 2,000 characters has one Markdown heading at most."""
    lines = text.replace("\r\n", "\n").split("\n")
    explicit = {i: m for i, line in enumerate(lines) if (m := ATX.match(line))}
    plain = len(explicit) <= FEW_HEADINGS and len(text.strip()) >= LONG_TEXT
    heads, at = [(0, 0, "", 0, "")], 0  # line, level, heading, lines that it takes, text on its line
    while at < len(lines):
        found = (len(explicit[at][1]), explicit[at][2].strip(), 1, "") if at in explicit else plain_heading(lines, at) if plain else None
        if found:
            heads.append((at, *found))
        at += found[2] if found else 1
    out = []
    for (line, level, heading, taken, rest), stop in zip(heads, [h[0] for h in heads[1:]] + [len(lines)], strict=True):
        content = "\n".join(([rest] if rest else []) + lines[line + taken : stop]).strip()
        if heading:
            out.append(Section(((level, heading),), line + 1, f"{'#' * level} {heading}\n{content}".strip()))
        elif content:
            out.append(Section((), 0, content))
    return out


def categorised(sections: list[Section]) -> list[Section]:
    """Front matter stands before the abstract, without one before the introduction, without that under headings of authors
    or none. Back matter goes by its heading; from references on all is references, until back matter."""
    keys = [heading_key(s.headings[0][1]) if s.headings else "" for s in sections]
    start = next((i for names in (ABSTRACT, INTRODUCTION) for i, k in enumerate(keys) if k in names), None)
    out, tail = [], "body"
    for i, (section, key) in enumerate(zip(sections, keys, strict=True)):
        if start is not None and i < start or start is None and (not key or key in FRONT_MATTER or any(p in key for p in FRONT_MATTER_PARTS)):
            category = "front_matter"
        elif key in BACK_MATTER:
            category, tail = "back_matter", "body"
        else:
            tail = "references" if key in REFERENCES else tail
            category = tail
        out.append(replace(section, category=category))
    return out


def joined(sections: list[Section], fits) -> list[Section]:
    """Neighbours in one, where `fits` says so of what is there and what follows."""
    out: list[Section] = []
    for section in sections:
        if out and fits(out[-1], section):
            out[-1] += section
        else:
            out.append(section)
    return out


def same_branch(a: Section, b: Section) -> bool:
    return not a.headings or not b.headings or a.headings[0][0] == b.headings[0][0]


def hard_split(text: str, most: int) -> list[str]:
    """Parts of at most `most` characters, cut at the last blank in their second half, else anywhere."""
    out, text = [], text.strip()
    while len(text) > most:
        at = text.rfind(" ", 0, most + 1)
        at = at if at >= most // 2 else most
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [p for p in (*out, text) if p]


def filled(parts: list[str], most: int, glue: str, longer) -> list[str]:
    """Neighbours joined by `glue` as long as they fit; `longer` cuts what doesn't fit alone."""
    out, held = [], ""
    for part in parts:
        if held and len(held) + len(glue) + len(part) > most:
            out.append(held)
            held = ""
        if len(part) > most:
            out += longer(part)
        else:
            held = f"{held}{glue}{part}" if held else part
    return [p.strip() for p in (*out, held) if p.strip()]


def prose(text: str, most: int) -> list[str]:
    """Text in parts: whole paragraphs, of longer ones whole sentences, of longer ones what fits."""
    by_sentence = lambda p: filled([s.strip() for s in SENTENCES.findall(p) if s.strip()], most, "", lambda s: hard_split(s, most))
    return filled([p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()], most, "\n\n", by_sentence) if len(text) > most else [text]


def structures(text: str) -> list[tuple[int, int, str]]:
    """Spans of structures; of those that overlap the first, of those that begin together the longest."""
    out: list[tuple[int, int, str]] = []
    for begin, _, end, kind in sorted((m.start(), -m.end(), m.end(), kind) for kind, p in STRUCTURES for m in p.finditer(text)):
        if not out or begin >= out[-1][1]:
            out.append((begin, end, kind))
    return out


def pieces_of(section: Section, most: int, whole: bool) -> list[Piece]:
    """A section's pieces: all of it, or prose in parts and each structure by itself, in lines where it is too long."""
    if whole:
        return [Piece(section.headings, section.category, "prose", "", 1, 1, section.text)]
    text, at, out = section.text.strip(), 0, []
    for n, (begin, end, kind) in enumerate([*structures(text), (len(text), len(text), "")], 1):
        if between := text[at:begin].strip():
            out += [("prose", "", p) for p in prose(between, most)]
        if body := text[begin:end].strip():
            named = " > ".join(h for _, h in section.headings)
            structure = f"structure-{kind}-{hashlib.sha1(f'{named}\n{kind}\n{n}\n{body}'.encode()).hexdigest()[:16]}"
            parts = [body] if len(body) <= most else filled(body.splitlines(keepends=True), most, "", lambda x: hard_split(x, most))
            out += [(kind, structure, p) for p in parts]
        at = end
    return [Piece(section.headings, section.category, kind, structure, i, len(out), p) for i, (kind, structure, p) in enumerate(out, 1)]


def ready(sections: list[Section], least: int, most: int) -> Iterator[tuple[Section, bool]]:
    """Sections as they are cut: those that are too small wait until they are large enough together, go before a section that
    they fit into, or go alone before one that they don't. True marks what still waits at the end."""
    waiting: Section | None = None
    for section in sections:
        small = len(section.text) < least and section.category not in WHOLE
        merged = waiting + section if waiting else section
        if small:
            waiting = merged
            if len(merged.text) >= least:
                yield merged, False
                waiting = None
        elif waiting and section.category not in WHOLE and len(merged.text) <= most:
            yield merged, False
            waiting = None
        else:
            if waiting:
                yield waiting, False
                waiting = None
            yield section, False
    if waiting:
        yield waiting, True


def split_document(text: str, least: int = 800, most: int = 1600) -> list[Piece]:
    if not 0 < least <= most:
        raise ValueError("least must be positive and at most `most`")
    sections = joined(categorised(sections_of(text)), lambda a, b: a.category == b.category and a.category in WHOLE)
    near = lambda a, b: a.category not in WHOLE and b.category not in WHOLE and len(b.text) < least and same_branch(a, b) and len(both(a.text, b.text)) <= most
    out: list[Piece] = []
    for section, left_over in ready(joined(sections, near), least, most):
        whole = section.category in WHOLE
        if left_over and out and len(both(out[-1].text, section.text)) <= most:
            last = out.pop()
            section = Section(last.headings + section.headings, 0, both(last.text, section.text), last.category)
        out += pieces_of(section, most, whole)
    return out


def section_pieces(df: DataFrame, key: str, text: str, least: int = 800, most: int = 1600) -> DataFrame:
    """key, piece, headings, category, kind, structure, part, parts, content, and for parts of one structure what they
    continue. Null and empty texts give no rows."""

    def rows(t: str) -> list[tuple]:
        found, seen = split_document(t, least, most), {}
        counts: dict[str, int] = {}
        for p in found:
            counts[p.structure] = counts.get(p.structure, 0) + 1
        out = []
        for i, p in enumerate(found):
            n = seen[p.structure] = seen.get(p.structure, -1) + 1
            before = f"{p.structure}:{n - 1}" if p.structure and n else None
            after = f"{p.structure}:{n + 1}" if p.structure and n + 1 < counts[p.structure] else None
            out.append((i, [h for _, h in p.headings], p.category, p.kind, p.structure, p.part, p.parts, before, after, p.text))
        return out

    schema = "piece int, headings array<string>, category string, kind string, structure string, part int, parts int, continues_from string, continues_to string, content string"
    return _per_text(df, key, text, schema, rows)


def section_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section (from 0), level, heading and content of every section. Null and empty texts give no rows."""

    def rows(t: str) -> list[tuple]:
        out = []
        for i, s in enumerate(sections_of(t)):
            level, heading = s.headings[0] if s.headings else (0, "")
            out.append((i, level, heading, s.text.partition("\n")[2].strip() if heading else s.text))
        return out

    return _per_text(df, key, text, "section int, level int, heading string, content string", rows)

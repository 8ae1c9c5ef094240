"""Windows of sections and files of records, against plain versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from scrivener import registry
from scrivener.functions import chunks as C
from scrivener.functions import text as X
from scrivener.sources import landed


def plain_windows(text: str, size: int, overlap: int) -> list[tuple]:
    if not text.strip():
        return []
    heads = list(re.finditer(r"(?m)^(#{1,6})\s+(.+?)\s*$", text))
    parts = [("文档首页" if heads else "正文", text[: heads[0].start()] if heads else text, 1)]
    parts += [(m[2].strip(), text[m.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)], text[: m.start()].count("\n") + 1) for i, m in enumerate(heads)]
    out = []
    for name, body, line in ((n, b.strip(), k) for n, b, k in parts):
        at = 0
        while at < len(body):
            end = min(len(body), at + size)
            if end < len(body):
                paragraph = body.rfind("\n\n", at + size // 2, end)
                cut = paragraph if paragraph > at else max(body.rfind("。", at, end), body.rfind(". ", at, end)) + 1
                end = cut if cut > at + size // 2 else end
            if body[at:end].strip():
                out.append((len(out) + 1, name, line + body[:at].count("\n"), body[at:end].strip()))
            if end >= len(body):
                break
            at = max(at + 1, end - overlap)
    return out


def test_windows():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(["w", "word ", "x. ", "。", "\n", "\n\n", "\n\n\n", "\n# Head\n", "\n## Other head \n", ".", " "]) for _ in range(rng.randint(0, 60)))
        size, overlap = rng.randint(6, 50), rng.randint(0, 5)
        assert C.section_windows(text, size, overlap) == plain_windows(text, size, overlap), (text, size, overlap)


def test_windows_of_the_whole_table(spark, sf_dir):
    got = sorted(tuple(r) for r in registry.queries()["graph_windows"](spark, sf_dir).select("doc_id", "window", "section", "line", "content").collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted((d["doc_id"], *w) for d in docs for w in plain_windows(d["text"] or "", 2000, 200)) and len(got) > len(docs)


def test_files(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc1") for _ in range(rng.randint(1, 9)))
    records = [(i, word() if rng.random() < 0.9 else "", f"Title {word()} {word()}" if rng.random() < 0.8 else None, rng.choice([None, word()]), rng.choice([None, f"https://doi.org/10.1/{word().upper()}"])) for i in range(60)]
    files = [f"/d/{rng.choice('xy')}/{rng.choice(['', 'Title ', 'pre-'])}{word()}{rng.choice(['', '_', ' '])}{rng.choice([r[1] for r in records])}{rng.choice(['', '_10.1_' + word()])}.pdf" for _ in range(80)] + ["/d/title.pdf", "/d/.pdf"]
    files = sorted(set(files))
    df = spark.createDataFrame([(k, t, e, d) for _, k, t, e, d in records], "record string, title string, external_id string, doi string").groupBy("record").agg(*(F.max(c).alias(c) for c in ("title", "external_id", "doi")))
    rows = df.select("*", X.normalize_title(F.coalesce("title", F.lit(""))).alias("t"), X.normalize_identifier(F.coalesce("doi", F.lit(""))).alias("d")).collect()
    stems = spark.createDataFrame([(f,) for f in files], "path string").select("path", F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("s")).withColumn("p", X.normalize_title(F.col("s"))).collect()
    got = {r["record"]: (r["path"], r["score"]) for r in landed.best_files(df, spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    want = {}
    for r in rows:
        def score(f, r=r):
            e = (r["external_id"] or "").strip().lower()
            hit = lambda n, h: bool(n) and n in h
            return 4 * hit(r["record"].lower(), f["s"]) + 3 * hit(e, f["s"]) + 3 * hit(r["d"].replace("/", "_"), f["s"]) + 2 * (bool(r["t"] and f["p"]) and (r["t"] in f["p"] or f["p"] in r["t"]))

        best = min(stems, key=lambda f: (-score(f), f["path"]))
        if score(best):
            want[r["record"]] = (best["path"], score(best))
    assert got == want and len(got) > 20 and len({s for _, s in got.values()}) > 3

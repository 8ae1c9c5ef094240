"""Findings of round 3: work and memory that grow no faster than the input, each with its result."""

from __future__ import annotations

import random

import pyarrow as pa

from scrivener import registry
from scrivener.functions import chunks as K
from scrivener.functions import tables as T
from scrivener.operators import citations as C
from scrivener.operators import library as L
from scrivener.operators import search as S
from scrivener.operators import selection as V


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_titles_that_begin_alike_do_not_meet_in_pairs(spark):
    """40,000 titles and as many references begin with the same two words; by those they'd be 1.6 billion pairs."""
    n = 40_000
    titles = spark.range(n).selectExpr("id as document", "concat('the theory of part ', id) as title", "'' as doi")
    refs = spark.range(n).selectExpr("id as citation", "concat('Lee. The theory of part ', id % 500, '. In the theory') as text", "'' as doi")
    got = L.local_document(refs, titles).selectExpr("count(*)", "count_if(document = citation % 500)").first()
    assert tuple(got) == (n, n)


def test_local_document_against_a_loop(spark):
    rng = random.Random(5)
    say = lambda a, b: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(a, b)))
    titles = [(i, rng.choice([say(1, 9), None, "", say(3, 3).upper() + "!"]), rng.choice(["", None, f"10.1/{i % 7}"])) for i in range(60)]
    refs = [(i, rng.choice([say(1, 40), None, "", say(5, 5)]), rng.choice(["", None, f"doi:10.1/{i % 9}."])) for i in range(200)]
    key = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()
    want = {}
    for c, text, doi in refs:
        by_title = [d for d, t, _ in titles if len(" ".join(key(t))) >= 12 and f" {' '.join(key(t))} " in f" {' '.join(key(text))} "]
        by_doi = [d for d, _, x in titles if x and doi and f"doi:{x}." == doi]
        want[c] = min(by_title) if by_title else min(by_doi, default=None)
    df = lambda rows, kind: spark.createDataFrame(rows, f"{kind} int, {'text' if kind == 'citation' else 'title'} string, doi string")
    got = {r["citation"]: r["document"] for r in L.local_document(df(refs, "citation"), df(titles, "document")).collect()}
    assert got == want and len({*want.values()}) > 10


def test_results_of_many_texts_are_handed_on_in_small_batches():
    """a batch of 2,000 texts with 100 kB of results each never stands whole in a task's Python."""
    n, most = 2000, 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([str(i) for i in range(n)])], names=["k", "__text"])
    seen = []
    for out in T.in_small_batches([batch], lambda t: ((i, t, "x" * 1000) for i in range(100)), ["k", "i", "t", "c"], ["int", "string", "string"]):
        most = max(most, out.nbytes)
        seen += zip(out.column("k").to_pylist(), out.column("i").to_pylist(), out.column("t").to_pylist(), strict=True)
    assert seen == [(k, i, str(k)) for k in range(n) for i in range(100)] and most < 3 * T.MOST_HELD


def test_phrases_are_read_once(spark, sf_dir):
    """F8: a text's topics are worked out by one step of the plan, and its rows aren't doubled."""
    topics = plan(registry.queries()["phrase_topics"](spark, sf_dir))
    assert topics.count("ccf concept") == 1 and "Expand" not in topics


def test_papers_are_read_once(spark, sf_dir):
    """what several fields need of a text is one step of the plan."""
    assert plan(registry.queries()["markdown_metadata"](spark, sf_dir)).count("(?s)```") == 1


def test_long_contexts_are_not_repeated_by_their_words(spark):
    """60 contexts of 6,000 words; a row for each word with all words of its context would be tens of GB."""
    contexts = spark.range(60).selectExpr("1 as document", "cast(id as int) as number", "0 as line", "array_join(transform(sequence(1, 6000), i -> concat('w', id, 'x', i)), ' ') as quote")
    citations = spark.range(60).selectExpr("concat('c', id) as citation", "1 as document", "cast(id as int) as number", "cast(null as int) as year", "array() as author_keys").withColumn("author_keys", C.F.array().cast("array<string>"))
    claims = spark.createDataFrame([(1, 1, None, "w7x1 w7x2 w7x3 w7x4 w7x5 none"), (2, 1, None, "w8x1 w8x2 none none none none"), (3, 2, None, "w7x1 w7x2 w7x3 w7x4 w7x5 w7x6")], "claim int, document int, line int, quote string")
    assert [tuple(r) for r in C.bound(claims, contexts, citations).collect()] == [(1, "c7")]


def test_documents_that_share_a_key_are_one(spark, duck):
    """F14, F16: a document's counts are one row; of rows that share a key a token's share is of the longest that has it."""
    rows = [(1, "apple"), (1, "apple pear pear fig"), (2, "pear"), (3, ""), (4, None), (5, "fig kiwi fig"), (5, "plum")]
    want = duck.execute(
        """WITH d AS (SELECT * FROM (VALUES (1, 'apple'), (1, 'apple pear pear fig'), (2, 'pear'), (3, ''), (4, NULL), (5, 'fig kiwi fig'), (5, 'plum')) AS d(id, t)),
        vt AS (SELECT id, len(w) AS l, unnest(w) AS token FROM (SELECT id, regexp_extract_all(lower(coalesce(t, '')), '[a-z]+') AS w FROM d)), vtf AS (SELECT id, token, count(*) / max(l) AS tf FROM vt GROUP BY ALL),
        vidf AS (SELECT token, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM vtf GROUP BY token), vw AS (SELECT token, 0.5 * idf AS qw FROM vidf WHERE token IN ('apple', 'fig')),
        vs AS (SELECT id, sum(tf * idf * coalesce(qw, 0)) / (sqrt(sum(tf * idf * tf * idf)) * (SELECT sqrt(sum(qw * qw)) FROM vw)) AS c FROM vtf JOIN vidf USING (token) LEFT JOIN vw USING (token) GROUP BY id)
        SELECT DISTINCT id, round(coalesce(c, 0), 9) FROM d LEFT JOIN vs USING (id) ORDER BY id"""
    ).fetchall()
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    got = sorted((r["doc_id"], round(r["tfidf"], 9)) for r in S.tfidf_cosine(df, "apple fig").collect())
    assert got == want


def test_candidates_of_a_question_are_not_dealt_to_one_task(spark, sf_dir, monkeypatch):
    """in each round the few questions' states are sent to the candidates, whose tokens aren't sorted."""
    plans, save = [], V.Scratch.save
    monkeypatch.setattr(V.Scratch, "save", lambda self, df: plans.append((df.columns, plan(df))) or save(self, df))
    registry.queries()["coverage_rounds"](spark, sf_dir)
    rounds = [p for c, p in plans if c == ["question", "b"]]
    assert rounds and all("strategy=broadcast" in p for p in rounds)


def test_a_round_of_assembly_looks_at_a_block(spark, monkeypatch):
    """of 5,000 candidates only blocks are held against what is taken, also where all of a block are refused."""
    blocks, save = [], V.Scratch.save
    monkeypatch.setattr(V.Scratch, "save", lambda self, df: blocks.append(df.columns) or save(self, df))
    say = "CASE WHEN id < 2000 OR id BETWEEN 2001 AND 4990 THEN array('a', 'b') ELSE array(concat('t', id)) END as tokens"
    members = spark.range(5000).selectExpr("'q' as question", "cast(id as string) as grp", "'p' as record", "id as chunk", "0 as seq", "id as ord", "false as structured", say, "10 as chars")
    got = V.assemble(members, spark.createDataFrame([("q", 9)], "question string, cap int"), 0.5, 4, 100).orderBy("place").collect()
    assert [r["chunk"] for r in got] == [0, 2000, 4991, 4992]
    held = [c for c in blocks if "least" in c and "parts" in c][1:]
    assert 2 <= len(held) < 12


def test_tokens_of_a_text_are_listed_once(monkeypatch):
    """packing listed each token for its paragraph, its sentence and its unit."""
    seen, pattern = [], T.WEIGHED

    class Counted:
        findall = staticmethod(lambda t: seen.append(len(t)) or pattern.findall(t))
        finditer = staticmethod(lambda t: seen.append(len(t)) or pattern.finditer(t))

    monkeypatch.setattr(T, "WEIGHED", Counted)
    text = "\n\n".join(" ".join(f"Sentence {i} of part {p} is here." for i in range(400)) for p in range(5))
    chunks = [size for _, size, _ in T.pack_weighed(T.weighed_units(text, 700), 500, 700, 80)]
    assert len(chunks) > 20 and max(chunks) <= 700 and sum(seen) <= len(text)


def test_neighbouring_chunks_are_measured_where_they_are_cut(spark, sf_dir):
    """neither chunks nor their tokens are shuffled, and the results are those of the window over chunks."""
    assert "Window" not in plan(registry.queries()["chunk_overlaps"](spark, sf_dir))
    rng = random.Random(18)
    parts = ["a", "Beta", "gamma-delta", "x.", "中文", " ", "\n", "\n\n", ". ", "。", "! ", "a.b.c", "q" * 70, "z.y-" * 30, "\r\n", "é", "\t"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(300, None), (301, ""), (302, "same words. " * 50)]
    df = spark.createDataFrame(texts, "k int, t string")
    got = sorted(tuple(r) for r in K.measured_chunks(df, "k", "t", 12, 20, 7, 9).collect())
    window = K.with_overlaps(T.token_chunks(df, "k", "t", 12, 20, 7), "k", "chunk", "content", 9)
    assert len(got) > 500 and got == sorted(tuple(r) for r in window.select("k", "chunk", "tokens", "overlap_tokens", "shared").collect())
    assert any(s for *_, s in got)


def test_words_are_listed_once_for_measured_overlaps(spark, sf_dir):
    """the step shared with measured_overlap_stats listed the words of texts twice and those of their pieces again."""
    assert plan(registry.queries()["measured_overlap_stats"](spark, sf_dir)).count("regexp_extract_all(") == 1


def test_pieces_are_not_shuffled_to_be_measured(spark, sf_dir):
    """of measured_overlap_stats texts are dealt out by document, not their pieces; the statistics need the other exchange."""
    found = registry.queries()["measured_overlap_stats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert found.index("Generate") < found.index("Exchange", found.index("Window")) and found.count("Exchange") == 2


def test_tokens_of_many_parts(spark):
    """a run like a.b.c of 30,000 parts, of which Java's patterns kept each on the stack, in text and in an array."""
    long = ".".join("ab" for _ in range(30_000))
    df = spark.createDataFrame([(1, 0, f"x y {long}"), (1, 1, f"{long} z"), (1, 2, "z")], "k int, j int, t string")
    listed = df.selectExpr("k", "j", "split(t, ' ') as t")
    assert [[r["shared"] for r in K.with_overlaps(d, "k", "j", "t").orderBy("j").collect()] for d in (df, listed)] == [[0, 1, 1]] * 2

"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scrivener.llm.class_model import class_model_scores
from scrivener.llm.decontaminate import contaminated, decontaminated
from scrivener.llm.packing import packed_documents
from scrivener.llm.pseudonyms import pseudonymised
from scrivener.llm.quality_classifier import scored
from scrivener.llm.quality_rules import judged
from scrivener.llm.sentence_spans import deduplicated
from scrivener.llm.simhash import near_duplicates
from scrivener.llm.token_counts import token_counts
from scrivener.llm.url_filter import judged_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, kept string, fingerprint string, n_tokens int, n_pseudonyms string, __id long, __found string"
ROWS = [
    (None, "a row without an id " * 20, "en", "s", 1, "k", 1, "x", "f", 1, "p", 1, "y"),
    (1, None, None, None, None, None, None, None, None, None, None, None, None),
    (2, "", "en", "s", 0, "k", 2, "x", "f", 2, "p", 2, "y"),
    (3, " \t\n ", "en", "s", 4, "k", 2, "x", "f", 2, "p", 2, "y"),
    (4, " ".join(f"The fox number {i} jumps over lazy dogs." for i in range(40_000)), "en", "s", None, "k", 2, "x", "f", 2, "p", 2, "y"),
    (5, "same row " * 60, "en", "s", 9, "k", 2, "x", "f", 2, "p", 2, "y"),
    (5, "same row " * 60, "en", "s", 9, "k", 2, "x", "f", 2, "p", 2, "y"),
    (6, "x" * 300_000, "en", "s", 9, "k", 2, "x", "f", 2, "p", 2, "y"),
    (7, "Some mail a.b@example.com here and 4539148803436467 there. " + " ".join(f"word{i}" for i in range(80)), "en", "s", 9, "k", 2, "x", "f", 2, "p", 2, "y"),
]
LABELS = [(1, 1, 0), (2, None, 0), (None, 1, 0), (4, 1, 0), (5, 0, 0), (5, 1, 0), (7, 1, None), (6, 0, 1)]
TOKENIZER, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = dict(classes=4, heads=16, sweeps=1, starts=1)

PER_ROW = {
    "op1": lambda d, _: pseudonymised(d, "k"),
    "op3": lambda d, _: near_duplicates(d),
    "op5": lambda d, _: deduplicated(d),
    "op6": lambda d, labels: judged(d, labels),
    "op7": lambda d, _: token_counts(d, PIECES),
    "op9": lambda d, _: class_model_scores(d, **SMALL),
    "op10": lambda d, labels: scored(d, labels),
}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(name, tables):
    docs, labels = tables
    out = PER_ROW[name](docs, labels).toPandas()
    assert len(out) == len(ROWS)
    assert sorted(out["doc_id"].fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    same = out[out["doc_id"] == 5]
    assert len(same.astype(str).drop_duplicates()) == 1


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(name, tables):
    docs, labels = (t.limit(0) for t in tables)
    assert PER_ROW[name](docs, labels).count() == 0
    assert PER_ROW[name](tables[0], labels).count() == len(ROWS)  # no label at all


def test_defined_results(tables):
    docs, labels = tables
    prints = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    assert [prints[i]["fingerprint"] for i in (1, 2, 3)] == ["0" * 16] * 3
    assert [prints[i]["component_id"] for i in (1, 2, 3)] == [1] * 3
    verdicts = {r["doc_id"]: r for r in judged(docs, labels).collect()}
    assert verdicts[1]["n_words"] == 0 and verdicts[1]["base_failed"] and not verdicts[1]["kept"]
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PIECES).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] > 4096
    texts = {r["doc_id"]: r["text"] for r in deduplicated(docs).collect()}
    assert texts[1] is None and texts[2] == ""
    swapped = {r["doc_id"]: r for r in pseudonymised(docs, "k").collect()}
    assert swapped[1]["text"] is None and swapped[7]["n_pseudonyms"] == 2 and swapped[6]["text"] == "x" * 300_000


def test_packing(tables):
    out = packed_documents(tables[0], TOKENIZER).toPandas()
    assert len(out[out["doc_id"] == 5]) == 2 and out["doc_id"].isna().sum() == 1
    assert out.loc[out["doc_id"] == 1, "length"].tolist() == [1]
    assert out.groupby("sequence_id")["length"].sum().max() <= 4096
    assert packed_documents(tables[0].limit(0), TOKENIZER).count() == 0


def test_decontamination(spark, tables):
    docs = tables[0]
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7", "k"), (1, "word1 word2 word3 word4 word5 word6 word7", "k"), (None, "lazy dogs the fox number", "k"), (2, None, "k"), (3, "", "k")], "item_id long, text string, h string")
    hits = contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits if r["item_id"] is not None} == {(7, 1)}
    left = decontaminated(docs, items)
    assert left.columns == docs.columns and left.filter("doc_id = 7").isEmpty()
    assert contaminated(docs.limit(0), items).count() == 0
    assert decontaminated(docs, items.limit(0)).count() == len(ROWS)


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "h"), (2, "", "h"), (3, "x://A.Example.NET/en/a?q#f", "h"), (3, "x://A.Example.NET/en/a?q#f", "h"), (None, "http://spam.io", "h"), (4, "a://b://c/d", "h"), (5, "http://" + "a" * 100_000, "h")],
        "page_id long, url string, host string",
    )
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/")]
    listed = spark.createDataFrame([("spam.io",), (None,), ("",), ("spam.io",)], "key string")
    got = {r["page_id"]: r for r in judged_urls(pages, rules, listed).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["verdict"]) == ("", "", "allow")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.net", "/en/a", "example.net/en/", "allow")
    assert got[None]["verdict"] == "block" and got[4]["host"] == "b:"
    assert judged_urls(pages, rules, listed).count() == 7
    assert judged_urls(pages.limit(0), rules, listed).count() == 0
    assert judged_urls(pages, rules, listed.limit(0)).filter("listed").isEmpty()


def test_pipeline_stages(spark, tables, tmp_path):
    docs, labels = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6 word7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= max(rows.count(), 0) + 200
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).groupBy("doc_id").count()
    assert kept.filter(F.col("count") > 1).isEmpty()


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """Before, op5 failed or cut clean sentences where two texts had one id, and the pipeline lost such rows."""
    passage = " ".join(f"Line {i} of a passage that is found twice." for i in range(30))
    clean = lambda tag: " ".join(f"{tag} speaks of matter {i} and of {tag} item {i * 7} in turn." for i in range(30))
    rows = [(0, passage), (1, clean("alpha") + " " + passage), (1, clean("beta")), (1, "short"), (None, clean("gamma") + " " + passage), (None, clean("delta"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in deduplicated(docs).collect()]
    assert len(got) == len(rows)
    for i in (0, 2, 3, 5):
        assert rows[i] in got
    cut = [t for d, t in got if t.startswith(("alpha", "gamma"))]
    assert len(cut) == 2 and all(t.count("passage") < 5 for t in cut)

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = ["The old mill by the river was sold to a young painter from the north.", "Trade in copper and tin fell sharply after the harbour froze last winter.", "Our cousin teaches seven children to read music on a borrowed violin."]
    prose = [" ".join(" ".join(w + str(k * j) for j, w in enumerate(t.split())) for k in range(1, 9)) for t in texts]
    rows = [(1, prose[0]), (1, prose[1]), (1, "no"), (None, prose[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {rows[0], rows[1], rows[3]}
    kept = corpus_pipeline.near_dedup(spark, docs.union(docs), str(tmp_path))
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect() if r[0]) == sorted(rows[:3]) and kept.filter("doc_id is null").count() == 1


def test_op1_long_names_and_hosts(spark):
    """Before, a host of some thousand labels ended the JVM by its matcher's recursion."""
    texts = ["x@" + "a." * 20_000 + "com", "x@" + "ab." * 20_000 + "com", "n" * 1_000_000 + "@mail.com", "@" * 100_000, "a@" * 50_000, "b" * 64 + "@mail.com", "c" * 65 + "@mail.com", "mail ann@" + "sub." * 126 + "org", "x@" + "-" * 500_000, "ann@mail." + "o" * 300_000]
    got = [tuple(r) for r in pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").select("text", "n_pseudonyms").collect()]
    assert [n for _, n in got] == [0, 1, 0, 0, 0, 1, 0, 1, 0, 1]
    for (new, n), old in zip(got, texts, strict=True):
        assert len(new) == len(old) and (new == old) == (n == 0) and new.partition("@")[2] == old.partition("@")[2]


def test_op4_rows_that_share_an_id_or_have_none(spark):
    """Before, rows without an id were left out, and an item could be found across two texts of one id."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    first, second = "one two three four five six seven eight", "five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, f"x {item} y"), (1, first), (1, second), (2, item), (2, item), (None, "nothing of it")], "doc_id long, text string")
    hits = contaminated(docs, spark.createDataFrame([(5, item), (6, "ten eleven twelve")], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in hits) == [("1", 6), ("2", 5), ("2", 6), ("None", 5), ("None", 6)]

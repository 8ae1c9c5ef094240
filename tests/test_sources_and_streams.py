"""Readers of landed payloads, sinks, and streams driven to their end."""

from __future__ import annotations

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivener.operators import jobs as batch
from scrivener.sources import landed, sinks
from scrivener.streaming import jobs as stream

ATOM = """<feed><entry><id>http://a.org/abs/1234.5v1</id><title>A
  title</title><summary> Some  text </summary><published>2021-03-04T00:00:00Z</published><author><name>Ann B</name></author><author><name>C D</name></author>
<link href="http://a.org/abs/1234.5v1" rel="alternate"/><link title="pdf" href="http://a.org/pdf/1234.5v1" rel="related" type="application/pdf"/></entry>
<entry><id>http://a.org/abs/9</id><title>Other</title><published>soon</published></entry></feed>"""
MEDLINE = """<S><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><ArticleTitle>On x</ArticleTitle><Abstract><AbstractText Label="A">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract>
<AuthorList><Author><LastName>Roe</LastName><ForeName>Jo</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>
<Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle></S>"""
CROSSREF = {"message": {"items": [{"DOI": "10.1/AB", "URL": "u", "title": ["T"], "container-title": ["V"], "author": [{"given": "G", "family": "F"}], "created": {"date-parts": [[2003, 1]]}, "published-online": {"date-parts": [[2001]]}}, {"DOI": "10.1/c"}]}}
OPEN = {"results": [
    {"id": "https://o.org/W1", "doi": "https://doi.org/10.2/X", "display_name": "N", "publication_year": 2020, "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}, "open_access": {"is_oa": True}, "authorships": [{"author": {"display_name": "Z"}}], "primary_location": {"pdf_url": "p", "source": {"display_name": "S"}}},
    {"id": "https://o.org/W2", "open_access": {"is_oa": False}},
]}


@pytest.fixture()
def paths(tmp_path):
    texts = {"atom": ATOM, "medline": MEDLINE, "crossref": json.dumps(CROSSREF), "open_index": json.dumps(OPEN)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return {name: str(tmp_path / name) for name in texts}


def test_records_of_all_sources(spark, paths):
    got = {(r["source"], r["external_id"]): r.asDict() for r in landed.records(spark, paths).collect()}
    assert len(got) == 6
    a = got["atom", "1234.5v1"]
    assert (a["title"], a["abstract"], a["year"], a["authors"], a["pdf_url"], a["url"]) == ("A title", "Some text", 2021, ["Ann B", "C D"], "http://a.org/pdf/1234.5v1", "http://a.org/abs/1234.5v1")
    assert got["atom", "9"]["year"] is None and got["atom", "9"]["url"] == "http://a.org/abs/9"
    m = got["medline", "77"]
    assert (m["abstract"], m["authors"], m["year"], m["venue"]) == ("First. Second.", ["Jo Roe", "The Group"], 1998, "J")
    c = got["crossref", "10.1/AB"]
    assert (c["year"], c["doi"], c["authors"], c["venue"]) == (2001, "10.1/ab", ["G F"], "V") and got["crossref", "10.1/c"]["title"] is None
    o = got["open_index", "W1"]
    assert (o["abstract"], o["doi"], o["pdf_url"], o["venue"], o["url"]) == ("a b a b", "10.2/x", "p", "S", "https://o.org/W1")
    with pytest.raises(ValueError):
        landed.records(spark, {"elsewhere": "x"})


def test_metrics_and_full_texts(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Title;SJR\nA;1,5\nA;0,5\nB;none\n;2,0\n")
    assert [tuple(r) for r in landed.journal_metrics(spark, str(tmp_path / "m.csv")).collect()] == [("A", 1.5)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/full.md").write_bytes(b"# x " + b"y" * 800)
    row = landed.full_texts(spark, str(tmp_path / "t")).select("path", landed.usable_text(F.col("text")).alias("ok")).first()
    assert row["path"].endswith("full.md") and row["ok"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.publish_sharded(old, str(tmp_path / "v1"), "id")
    assert spark.read.parquet(str(tmp_path / "v1")).count() == 2
    old.write.parquet(str(tmp_path / "w1"))
    sinks.merge_into(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), str(tmp_path / "w1"), str(tmp_path / "w2"), ["id"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "w2")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    log = spark.createDataFrame([("j", i) for i in range(5)], "job string, seq int")
    assert sorted(r["seq"] for r in sinks.append_trimmed(spark.createDataFrame([("j", 9)], log.schema), log, "job", "seq", 3).collect()) == [3, 4, 9]


def landed_events(tmp_path) -> list[dict]:
    kinds = ["log", "progress", "log", "log", "progress", "progress", "result", "log", "progress", "done"]
    rows = [{"job": j, "sequence": i, "kind": k, "payload": "", "ts": f"2024-01-01T00:{m:02d}:{i:02d}Z"} for m, j in enumerate("ab") for i, k in enumerate(kinds)]
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(r) for r in rows if (r["sequence"] >= 5) == n))
        os.utime(tmp_path / f"in/{n}.json", (n + 1, n + 1))  # files are read in the order of their times
    return rows


def run(df, tmp_path, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).toPandas()


def test_stream_buffer_equals_its_batch_twin(spark, tmp_path):
    rows = landed_events(tmp_path)
    got = run(stream.bounded_buffer(stream.ndjson(spark, str(tmp_path / "in"), files_per_trigger=1), 8), tmp_path, "append", "buffered")
    assert len(got) == len(rows)
    gone = set(zip(got["job"], got["replaces"], strict=True))
    left = {(j, s) for j, s, ok in zip(got["job"], got["sequence"], got["admitted"], strict=True) if ok} - gone
    twin = batch.bounded_buffer(spark.createDataFrame(pd.DataFrame(rows)[["job", "sequence", "kind"]]), "job", "sequence", "kind", 8)
    assert left == {(r["job"], r["sequence"]) for r in twin.collect()}


def test_stream_states_and_first_submissions(spark, tmp_path):
    landed_events(tmp_path)
    events = stream.ndjson(spark, str(tmp_path / "in"))
    states = run(stream.latest_states(events), tmp_path, "complete", "states")
    assert set(zip(states["job"], states["state"], strict=True)) == {("a", "done"), ("b", "done")}
    first = run(stream.one_active_per_key(events, ["job"]), tmp_path, "append", "first")
    assert sorted(first["job"]) == ["a", "b"]
    quiet = run(stream.silent_jobs(events), tmp_path, "append", "quiet")
    assert quiet["job"].tolist() == ["a"] and quiet["events"].tolist() == [10]

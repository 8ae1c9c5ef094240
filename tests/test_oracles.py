"""Every registered query of the library against its SQL, and the driver's entry points."""

from __future__ import annotations

import pytest

import __spark_entry__
from scrivener import registry
from scrivener.operators import graphs

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same_rows):
    same_rows(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_is_repeatable(name, spark, sf_dir):
    first, again = (registry.queries()[name](spark, sf_dir) for _ in range(2))
    rows = sorted(map(repr, first.collect()))
    assert rows and rows == sorted(map(repr, again.collect()))


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_more_short_passages_than_a_thousand(spark):
    """Before, only an arbitrary thousand of the passages of few words were looked for."""
    texts = [(i, f"head w{i} tail{i} x{i} and so, on\tit goes{i}. Ends") for i in range(1500)] + [(2000, ""), (2001, None), (2002, "ab"), (2003, "one  two")]
    short = [(i, f"w{i} tail{i} x{i}") for i in range(1200)] + [(3000 + i, p) for i, p in enumerate(["", "a", "ab", "goes7", "es7.", "so, on", "so, on\tit goes3", "tail5 x5 and so, on", " ", "e  t", "w1 tail1 x1 and so, on", "nowhere"])] + [(4000, None)]
    got = graphs.contained_passages(spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(short, "p long, text string"), "t", "p").collect()
    want = [(t, p) for t, text in texts if text is not None for p, passage in short if passage is not None and passage in text]
    assert sorted(tuple(r) for r in got) == sorted(want)

"""One local session for all tests, and DuckDB views over the fixture tables."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from scrivener.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, shuffle_partitions=8, app="tests", memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    """A value as compared: doubles to nine digits, nested values as tuples."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a registered query returns what its SQL returns, as a bag of rows."""

    def check(query, sql: str, sf: str = SF) -> None:
        df = query(spark, sf)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.toArrow().to_pylist()), key=repr)
        found = duck.execute(sql).to_arrow_table()
        assert sorted(found.column_names) == columns
        want = sorted((tuple(plain(r[c]) for c in columns) for r in found.to_pylist()), key=repr)
        assert len(got) == len(want)
        assert got == want

    return check

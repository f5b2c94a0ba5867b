"""Every registered query of the catalogue against its SQL."""

import pytest

from stowage import catalogue

from .oracle import assert_equal, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    assert_equal(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])



def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def events(folder, rows):
    """A folder of events (event_id, minute, user_id, event_type)."""
    import duckdb

    values = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-03-10 00:00:00' + INTERVAL ({m}) MINUTE, {u}::BIGINT, '{e}')" for i, m, u, e in rows)
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type)) TO '{folder}/events.parquet'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


#: A job whose last minute has not its largest id, ids beyond ten million, and hours that New York's clocks skip.
FAR = [(40_000_000, 0, 1, "a"), (1, 1, 1, "b"), (2, 2, 1, "a"), (90_000_000, 150, 1, "b"), (3, 151, 1, "a"), (4, 5, 2, "c")]


def test_final_events_by_rank_in_any_zone(new_york, tmp_path, con):
    own = events(tmp_path, FAR)
    assert_equal(catalogue.QUERIES["q_progress_final"](new_york, str(tmp_path)), own, catalogue.ORACLES["q_progress_final"])
    assert_equal(catalogue.QUERIES["q_progress_final"](new_york, SF), con, catalogue.ORACLES["q_progress_final"])


#: Entries of one minute, and ids that differ by more than ten million within a batch.
TIED = [(40_000_000, 0, 1, "a"), (30_000_000, 0, 1, "b"), (1, 1, 1, "a"), (2, 500, 1, "c"), (3, 150, 2, "c"), (50_000_000, 151, 2, "b"), (9, 152, 2, "b")]


def test_batches_by_rank_in_any_zone(new_york, tmp_path, con):
    own = events(tmp_path, TIED)
    assert_equal(catalogue.QUERIES["q_session_batch"](new_york, str(tmp_path)), own, catalogue.ORACLES["q_session_batch"])
    assert_equal(catalogue.QUERIES["q_session_batch"](new_york, SF), con, catalogue.ORACLES["q_session_batch"])


def test_stream_sessions_split_at_the_gap_itself(new_york, tmp_path):
    """Requests 399, 400 and 401 ticks after each other: the SQL splits from 400 on."""
    own = events(tmp_path, [(1, 0, 1, "a"), (2, 399, 1, "b"), (3, 799, 1, "c"), (4, 1200, 1, "d"), (5, 1599, 1, "d"), (6, 0, 2, "a")])
    assert_equal(catalogue.QUERIES["q_session_stream"](new_york, str(tmp_path)), own, catalogue.ORACLES["q_session_stream"])

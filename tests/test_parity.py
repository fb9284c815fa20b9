"""Registered queries against DuckDB: one per family, or all with TRACELOOM_PARITY=all."""

import os

import pytest

import __spark_entry__ as entry
from parity import compare, duck

SF = "/root/testdata/sf0.001"
FEW = ("classify_events", "leads", "dedupe_events", "normalize_for_search", "correlate", "media_copies",
       "fleet_correlation", "hash_history", "select_where", "linked", "recognize", "read_journal",
       "read_shell_history", "read_usb_events", "session_activity")
NAMES = sorted(entry.queries()) if os.environ.get("TRACELOOM_PARITY") == "all" else FEW


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, name):
    wrong, _ = compare(spark, duck(SF), SF, name)
    assert wrong is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150

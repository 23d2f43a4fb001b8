"""The registered queries hang together."""

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_is_registered():
    assert "most_changed_documents" in entry.queries()

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries of the library without its corpus operators.
COUNT = 107


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


def test_every_query_has_a_name_and_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.reference.QUERIES) == COUNT
    assert all(f"op{n}_" in " ".join(entry.queries()) for n in range(1, 14)) or not entry._llm()[0]


@pytest.mark.parametrize("name", ["pair_gate", "split_hash_exact", "group_advantage", "card_documents", "near_duplicates", "source_task_records", "source_labels", "sink_json_lines", "unused_positions", "windowed_counts"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0

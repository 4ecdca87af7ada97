"""Near-duplicate links through rows that have no doc_id."""

import pytest

from marlpit.llm import jaccard_join


@pytest.mark.parametrize("in_task", [2, jaccard_join.IN_TASK])
def test_rows_without_ids_link(spark, in_task):
    words = [f"w{i}" for i in range(120)]

    def changed(*at):
        return " ".join(f"new{i}" if i in at else w for i, w in enumerate(words))

    # 1 and 2 differ too much to link, the row between them is near both.
    rows = [(1, changed(10, 30)), (None, changed(10, 60)), (2, changed(60, 90)), (None, changed(10, 60, 119)), (3, "other words only stand here now")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(table, in_task=in_task).collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in got) == [(0, 1), (0, 1), (1, 1), (2, 1), (3, 3)]

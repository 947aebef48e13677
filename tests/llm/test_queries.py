"""Every query of the text problems runs over the smallest tables with the columns it promises."""

import pytest

from skiffline.llm.queries import QUERIES

COLUMNS = {"p3_found": ["item", "item_id", "char_start", "pii_type"], "p4_found": ["item", "item_id", "seg_no", "lang"], "p7_found": ["item", "item_id", "category"], "p10_found": ["doc_id", "char_start", "char_end"]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
    if name.endswith("_found"):
        assert {t for _, t in df.dtypes} <= {"bigint", "string"}
        assert df.distinct().count() == df.count()

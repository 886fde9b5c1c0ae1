"""Every query of the ten problems runs on the smallest tables with the columns asked for."""

import os

import pytest

from foliomark.llm import catalogue

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["doc_id", "line_no", "defect"], "p2_found": ["doc_id_a", "doc_id_b"], "p3_found": ["record_kind", "record_id", "span_start", "span_end"], "p4_found": ["doc_id", "sentence_end"],
    "p5_found": ["record_kind", "record_id", "form"], "p6_found": ["doc_id", "paragraph_index", "lang"], "p7_found": ["doc_id"], "p10_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert df.count() == df.distinct().count()
    else:
        assert df.count() >= 0

import compare
import pytest

from corpusloom.llm.queries import queries
from corpusloom.llm.sql import oracle_sql

COLUMNS = {
    "p1_found": ["doc_id_a", "doc_id_b"], "p2_found": ["parent_doc_id", "token_offset_in_parent", "token_end_in_parent"], "p3_found": ["doc_id_a", "doc_id_b"],
    "p4_found": ["lane", "group_index"], "p5_found": ["item_id", "doc_id"], "p6_found": ["source"], "p7_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, name):
    df = queries()[name](spark, data)
    rows = df.toPandas()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and not rows.duplicated().any()
    if name in oracle_sql():
        assert compare.rows(rows) == compare.rows(compare.connect(data).execute(oracle_sql()[name]).df())

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_tables import MESSY, MESSY_IDS, table  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    """Null and empty texts, null and repeated ids, a repeated row, copies, a long text, clashing columns."""
    rows = table(spark, MESSY, MESSY_IDS)
    return rows.unionByName(rows.where("doc_id = 6"))


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])

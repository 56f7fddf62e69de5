"""The operators that are one map read two columns and shuffle nothing."""

import os
import re

import pytest

from arcframe.llm import common
from arcframe.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize(("name", "columns"), [("op1_media_columns", "doc_id:bigint,text:string"), ("op3_language_id", "doc_id:bigint,text:string"), ("op5_html_text", "page_id:bigint,html:string"), ("op6_pii_pseudonyms", "doc_id:bigint,text:string"), ("op9_token_counts", "doc_id:bigint,text:string")])
def test_maps(spark, monkeypatch, name, columns):
    monkeypatch.setattr(common, "SMALL", 0)  # else a table of one file is dealt over all tasks first
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{columns}>" in text and "Exchange" not in text and len(re.findall("MapInArrow", text)) == 1

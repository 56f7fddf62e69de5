"""Shapes of plans: columns and filters reach the scan, and plain operators stay in the JVM."""

import os
import re

import pytest
from pyspark.sql import functions as F

from arcframe.operators import entries as E
from arcframe.plans import catalogue, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")

PYTHON = {"listing_parse", "xattr_dump", "decode_values", "sort_rules", "stream_round_trip", "compress_ratio", "file_dedup_exact", "fragment_pack", "pack_statistics", "directory_runs", "tar_round_trip", "image_round_trip"}

#: Archives, images, codecs, streams with state and functions of a caller.
FORMATS = {
    "tar_formats", "tar_attributes", "tar_sparse", "tar_numbers", "image_attributes", "image_attribute_table", "image_tables", "image_file_stream", "image_block_words", "attribute_map_file", "block_checksum", "url_decode",
    "codec_gzip", "codec_lzma", "codec_xz", "codec_lz4", "codec_zstd", "stream_gzip", "stream_xz", "stream_bzip2", "directory_round_trip", "engine_pack", "engine_convert", "engine_diff", "engine_unpack", "worker_callback",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - PYTHON - FORMATS))
def test_no_python_in_plain_operators(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(catalogue.QUERIES[name](spark, SF)))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(E.of_types(views.contents(spark, SF).select("path", "seq", F.lit(0o100644).alias("mode")), ["f"]).select("path"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string,source:string>", text)  # no texts
    rows = views.files(spark, SF).where("key = 7").select("path")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderkey,7\)", plan(rows)) and "o_totalprice" not in re.findall("ReadSchema: [^\n]*", plan(rows))[0]


def test_first_names_are_combined_before_the_shuffle(spark):
    assert "partial_min" in plan(catalogue.QUERIES["block_digest_dedup"](spark, SF)) and "partial_min" in plan(catalogue.QUERIES["hard_link_detect"](spark, SF))
    assert "Window" not in plan(catalogue.QUERIES["hard_link_detect"](spark, SF))

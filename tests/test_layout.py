"""Bucketed layout: joins on the bucket key need no exchange; a table belongs to its source."""

import pytest

from textlab.sources import layout as L

SF001 = "/root/testdata/sf0.001"


def test_bucketed_layout_joins_without_exchange(spark):
    L.lay_out(spark, SF001, "textlab_bkt", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = L.laid_out(spark, SF001, "textlab_bkt", "documents")
        joined = d.join(L.laid_out(spark, SF001, "textlab_bkt", "labels"), "doc_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == spark.read.parquet(f"{SF001}/labels.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_layout_of_another_folder_is_refused(spark):
    L.lay_out(spark, SF001, "textlab_bkt", 4)
    with pytest.raises(ValueError):
        L.laid_out(spark, "/another/folder", "textlab_bkt", "documents")

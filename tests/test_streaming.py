"""The stateless operators on Structured Streaming frames give the batch result."""

from pyspark.sql import functions as F

from textlab.operators import scoring as S
from textlab.sources import driver as D
from textlab.streaming import pipeline as SP

from conftest import SF001


def test_vote_stream_equals_batch(spark, tmp_dir):
    aligned = S.align_scores(S.member_probs(D.member_logits(spark, SF001)))
    aligned.write.mode("overwrite").parquet(f"{tmp_dir}/aligned")
    stream = spark.readStream.schema(aligned.schema).parquet(f"{tmp_dir}/aligned")
    SP.run_to_parquet(SP.vote_stream(stream), f"{tmp_dir}/vote_out", f"{tmp_dir}/vote_ckpt")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/vote_out").collect()))
    want = sorted(map(tuple, S.soft_vote(aligned).collect()))
    assert got == want and len(got) > 0


def test_clean_pages_stream_equals_batch(spark, tmp_dir):
    stream = SP.read_table_stream(spark, SF001, "pages", SP.PAGES_SCHEMA)
    SP.run_to_parquet(SP.clean_pages(stream), f"{tmp_dir}/pages_out", f"{tmp_dir}/pages_ckpt")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_dir}/pages_out").collect()))
    batch = SP.clean_pages(spark.read.parquet(f"{SF001}/pages.parquet"))
    assert got == sorted(map(tuple, batch.collect()))
    assert all(r[2] >= 0 for r in got)


def test_table_stream_reads_a_folder_of_files(spark, tmp_dir):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>page {i}</p>") for i in range(20)], SP.PAGES_SCHEMA)
    pages.repartition(3).write.parquet(f"{tmp_dir}/pages.parquet")
    from textlab.plans import QUERIES, load_all
    load_all()
    got = sorted(map(tuple, QUERIES["stream_clean_pages"](spark, tmp_dir).collect()))
    assert got == sorted((i, f"page {i}", 2) for i in range(20))
    pages.limit(0).write.mode("overwrite").parquet(f"{tmp_dir}/pages.parquet")
    assert QUERIES["stream_clean_pages"](spark, tmp_dir).count() == 0

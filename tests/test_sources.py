"""Delimited readers and writers on invented files."""

import os

import pytest

from textlab.sources import delimited as IO


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_paragraph_scan_rules(spark, tmp_dir):
    body = ("Disclaimer line one\nline two\nline three\nline four\n\n"
            "1\t@@1\tmigrant\tgb\tplain text\t0\n"
            "2\t@@2\tpoor\tgb\t\"quoted\ttab\"\t3\n"
            "3\t@@3\twomen\tus\ttoo\tmany\t1\n"
            "4\t@@4\trefugee\tng\n"
            "5\t@@5\thomeless\tke\tNA\t2\n")
    write(f"{tmp_dir}/p/a.tsv", body)
    rows = {r.par_id: r for r in IO.read_paragraph_tsv(spark, f"{tmp_dir}/p").collect()}
    assert sorted(rows) == [1, 2, 4, 5]          # 7-field row dropped, disclaimers dropped
    assert rows[2].text == "quoted\ttab"
    assert rows[4].text is None and rows[4].label is None  # short row padded
    assert rows[5].text is None                 # NA string -> null
    assert rows[1].label == 0 and rows[2].label == 3


def test_dev_labels_scan(spark, tmp_dir):
    write(f"{tmp_dir}/d/dev.csv", 'par_id,label\n12,"[0, 1, 0]"\n12.0,"[0,0]"\nx,"[1]"\n')
    rows = [tuple(r) for r in IO.read_dev_labels_csv(spark, f"{tmp_dir}/d").collect()]
    assert rows == [(12, "[0, 1, 0]"), (12, "[0,0]")]


def test_unlabelled_scan_fails_on_bad_row(spark, tmp_dir):
    write(f"{tmp_dir}/u/t.tsv", "1\t@@1\tk\tgb\tfine\n2\t@@2\tk\tgb\ttext\textra\n")
    with pytest.raises(Exception):
        IO.read_unlabelled_tsv(spark, f"{tmp_dir}/u").collect()


def test_over_long_rows_with_an_empty_spare_field_go(spark, tmp_dir):
    body = "1\t@@1\tk\tgb\tfine\t0\n2\ta\tk\tgb\tmany\t1\t\textra\n3\ta\tk\tgb\ttrailing\t1\t\n4\ta\tk\tgb\t\t1\n"
    write(f"{tmp_dir}/p/a.tsv", body)
    for multi_line in (False, True):
        rows = {r.par_id: r.text for r in IO.read_paragraph_tsv(spark, f"{tmp_dir}/p", multi_line).collect()}
        assert rows == {1: "fine", 4: None}


def test_large_ids_keep_every_digit(spark, tmp_dir):
    write(f"{tmp_dir}/d/dev.csv", 'par_id,label\n9007199254740993,"[0]"\n12d,"[0]"\n1.2e1,"[1]"\n')
    assert [r.par_id for r in IO.read_dev_labels_csv(spark, f"{tmp_dir}/d").collect()] == [9007199254740993, 12]


def test_prediction_sink_keeps_order(spark, tmp_dir):
    df = spark.range(0, 5000).select(F_pos(), ((F_id() * 7) % 2).cast("int").alias("pred"))
    IO.write_predictions(df.repartition(7), f"{tmp_dir}/preds", lines_per_file=900)
    back = sorted((r.line_no, r.pred) for r in IO.read_predictions(spark, f"{tmp_dir}/preds").collect())
    assert back == [(i, (i * 7) % 2) for i in range(5000)]
    with open(sorted(p for p in _files(f"{tmp_dir}/preds"))[0]) as fh:
        assert fh.readline().strip() == "0"


def test_prediction_files_are_read_in_number_order(spark, tmp_dir):
    for n in range(1100):  # names sorted as text would put c1000 before c101
        write(f"{tmp_dir}/many/part-00000-x-c{n:03d}.txt", f"{n % 2}\n{n // 2 % 2}\n")
    back = [r.pred for r in IO.read_predictions(spark, f"{tmp_dir}/many").orderBy("line_no").collect()]
    assert back == [v for n in range(1100) for v in (n % 2, n // 2 % 2)]


def F_pos():
    from pyspark.sql import functions as F
    return F.col("id").alias("pos")


def F_id():
    from pyspark.sql import functions as F
    return F.col("id")


def _files(d):
    return [os.path.join(d, f) for f in os.listdir(d) if f.startswith("part-")]


def test_one_line_rows_keep_their_texts(spark, tmp_dir):
    texts = ["a\nb", "a\r\nb\r", "100% %0A %25 %0D", '"quoted\n"', "tab\there", "%", "\n"]
    rows = [(i, "@@1", "k", "en", t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "par_id long, art_id string, keyword string, country_code string, text string, label int")
    IO.write_delimited(df, tmp_dir + "/p", one_line=True)
    lines = spark.read.text(tmp_dir + "/p").count()
    assert lines == len(texts)  # a row is a line, so large files can be split anywhere
    got = {r.par_id: r.text for r in IO.read_paragraph_tsv(spark, tmp_dir + "/p", one_line=True).collect()}
    assert got == dict(enumerate(texts))

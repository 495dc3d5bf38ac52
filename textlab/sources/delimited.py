"""Delimited-file sources and sinks.

Readers reproduce the labelled corpus' loading rules with Spark's CSV
reader: rows with too many fields are dropped (also when the fields too many
are empty), short rows are padded with nulls, disclaimer lines fall out because their id
is not numeric, and pandas' NA strings become nulls.  No ``inferSchema``.

``multi_line`` allows quoted newlines; Spark then reads each file in one task,
so writers here always produce many part files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import coerce_id, na_to_null, strict_cast

# FIXED VALUES: the column names of the corpus files, in file order.
PARAGRAPH_COLUMNS = ("par_id", "art_id", "keyword", "country_code", "text", "label")
SPAN_COLUMNS = ("par_id", "art_id", "text", "keyword", "country_code", "span_start",
                "span_finish", "span_text", "pcl_category", "num_annotators")
UNLABELLED_COLUMNS = ("id", "art_id", "keyword", "country_code", "text")

#: Size of a written file that one task may have to read whole (quoted line breaks).
FILE_BYTES = 64 << 20


def _string_schema(cols, spare: bool) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in cols]
    if spare:
        fields.append(T.StructField("_bad", T.StringType(), True))
    return T.StructType(fields)


def _reader(spark: SparkSession, schema: T.StructType, sep: str, multi_line: bool,
            header: bool = False, mode: str = "PERMISSIVE"):
    return (spark.read.schema(schema)
            .option("sep", sep).option("quote", '"').option("escape", '"')
            .option("header", header).option("mode", mode)
            .option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", "_bad")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def _lenient_rows(raw: DataFrame, cols, sep: str = "\t") -> DataFrame:
    """Drop over-long rows and rows whose id is not numeric (disclaimer
    lines); turn NA strings into nulls.

    A row with another number of fields than ``cols`` keeps its raw text in
    ``_bad``; it is over-long when it has as many separators outside quotes as
    there are columns, whether or not the fields after them are empty.
    """
    unquoted = F.regexp_replace("_bad", f'(^|{sep})"(?:[^"]|"")*"', "$1")
    seps = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
    kept = raw.where(F.col("_bad").isNull() | (seps < len(cols))).drop("_bad")
    kept = kept.select(*[na_to_null(c).alias(c) for c in cols])
    return kept.withColumn(cols[0], coerce_id(cols[0])).where(F.col(cols[0]).isNotNull())


def to_one_line(col) -> Column:
    """Line breaks of a text as ``%0A`` and ``%0D`` (and ``%`` as ``%25``), so that a row is one line."""
    c = F.replace(col, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def from_one_line(col) -> Column:
    """The text of :func:`to_one_line`; ``%25`` is undone last, so nothing is taken twice."""
    c = F.replace(F.replace(col, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r"))
    return F.replace(c, F.lit("%25"), F.lit("%"))


def _restored(df: DataFrame, one_line: bool) -> DataFrame:
    if not one_line:
        return df
    return df.select(*[from_one_line(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_paragraph_tsv(spark: SparkSession, path: str, multi_line: bool = False, one_line: bool = False) -> DataFrame:
    """``multi_line``: quoted fields may hold line breaks, so a file is read by one task; ``one_line``: the
    rows were written with :func:`to_one_line`, and large files are split."""
    raw = _reader(spark, _string_schema(PARAGRAPH_COLUMNS, True), "\t", multi_line).csv(path)
    df = _restored(_lenient_rows(raw, PARAGRAPH_COLUMNS), one_line)
    return df.withColumn("label", strict_cast("label", "double").cast("int"))


def read_span_tsv(spark: SparkSession, path: str, multi_line: bool = False, one_line: bool = False) -> DataFrame:
    raw = _reader(spark, _string_schema(SPAN_COLUMNS, True), "\t", multi_line).csv(path)
    df = _restored(_lenient_rows(raw, SPAN_COLUMNS), one_line)
    for c in ("span_start", "span_finish", "num_annotators"):
        df = df.withColumn(c, strict_cast(c, "double").cast("int"))
    return df


def read_dev_labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV ``par_id,label``; ids coerced leniently, junk ids dropped."""
    schema = T.StructType([T.StructField("par_id", T.StringType()), T.StructField("label", T.StringType())])
    raw = _reader(spark, schema, ",", False, header=True).csv(path)
    return (raw.select(coerce_id("par_id").alias("par_id"), na_to_null("label").alias("label"))
            .where(F.col("par_id").isNotNull()))


def read_unlabelled_tsv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Headerless 5-column TSV, nothing skipped: a malformed row is an error."""
    raw = _reader(spark, _string_schema(UNLABELLED_COLUMNS, False), "\t", multi_line,
                  mode="FAILFAST").csv(path)
    return raw.select(strict_cast("id", "bigint").alias("id"), "art_id", "keyword", "country_code",
                      na_to_null("text").alias("text"))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = False, one_line: bool = False) -> None:
    if one_line:
        df = df.select(*[to_one_line(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    (df.write.mode("overwrite")
     .option("sep", sep).option("quote", '"').option("escape", '"').option("header", header)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


# ------------------------------------------------------------------ predictions

#: Lines of one prediction file.
LINES_PER_FILE = 1_000_000


def write_predictions(preds: DataFrame, path: str, pos: str = "pos", pred: str = "pred",
                      lines_per_file: int = LINES_PER_FILE) -> None:
    """One ``0``/``1`` per line in ``pos`` order.

    Range partitioning on ``pos`` and a sort inside each partition make the
    part files, read in the order of their numbers, the global order.  The
    number of partitions comes from the row count, and each is one file.
    """
    n = max(1, -(-preds.count() // lines_per_file))
    (preds.repartitionByRange(n, F.col(pos)).sortWithinPartitions(pos)
     .select(F.col(pred).cast("string").alias("value"))
     .write.mode("overwrite").text(path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, pred)`` with 0-based global line numbers.

    Files are ordered by the numbers in their names (partition, then file of
    the partition), which names sorted as text are not past 99,999 partitions
    or 999 files.  Line numbers inside a file come from a window per file, file
    offsets from a running sum over the per-file counts (one row per file).
    """
    name = F.input_file_name()
    part = F.regexp_extract(name, r"part-([0-9]+)[^/]*$", 1).cast("long")
    file = F.coalesce(F.regexp_extract(name, r"-c([0-9]+)[^/]*$", 1).try_cast("long"), F.lit(0))
    raw = spark.read.text(path).select(
        part.alias("_p"), file.alias("_f"), F.monotonically_increasing_id().alias("_i"),
        F.col("value").cast("int").alias("pred"))
    in_file = raw.withColumn("_l", F.row_number().over(Window.partitionBy("_p", "_f").orderBy("_i")) - 1)
    per_file = in_file.groupBy("_p", "_f").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_p", "_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("_p", "_f", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o"))
    return (in_file.join(offsets, ["_p", "_f"])
            .select((F.col("_o") + F.col("_l")).cast("long").alias("line_no"), "pred"))


# ------------------------------------------------------------------ misclassified

MISCLASSIFIED_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("true_label", T.IntegerType()),
    T.StructField("predicted_label", T.IntegerType()), T.StructField("ensemble_score", T.DoubleType())])


def write_misclassified(df: DataFrame, path: str, score: bool = True, one_line: bool = False) -> None:
    """The error file; the score column is left out with ``score=False``."""
    columns = ["text", "true_label", "predicted_label"] + (["ensemble_score"] if score else [])
    write_delimited(df.select(*columns), path, sep=",", header=True, one_line=one_line)


def plain_errors(df: DataFrame) -> DataFrame:
    """The notebook form of the error rows: line feeds and commas in the text as
    spaces (so no field needs quotes), the score at four decimals."""
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(","), F.lit(" "))
    return df.select(text.alias("text"), "true_label", "predicted_label",
                     F.round("ensemble_score", 4).alias("ensemble_score"))


def read_misclassified(spark: SparkSession, path: str, multi_line: bool = True, one_line: bool = False) -> DataFrame:
    """The error file; one without line breaks in its texts needs no ``multi_line`` and is split."""
    return _restored(_reader(spark, MISCLASSIFIED_SCHEMA, ",", multi_line and not one_line, header=True).csv(path), one_line)


# ------------------------------------------------------------------ reports

def write_report(report: DataFrame, path: str, title: str) -> None:
    """Markdown-ish text report from a long ``(section, item, value)`` table, in
    section and item order.

    The table is small by construction (one row per metric), so one output
    file is fine; lines are formatted on the executors."""
    shown = F.when(F.col("value").isNotNull(), F.format_string("%.6f", "value")).otherwise("")
    line = F.format_string("| %s | %s | %s |", F.col("section"), F.col("item"), shown)
    head = report.sparkSession.createDataFrame(
        [(0, "", "", f"# {title}"), (1, "", "", "| section | item | value |"), (2, "", "", "|---|---|---|")],
        "o int, section string, item string, line string")
    body = report.select(F.lit(3).alias("o"), "section", "item", line.alias("line"))
    (head.unionByName(body).coalesce(1).sortWithinPartitions("o", "section", "item").select("line")
     .write.mode("overwrite").text(path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line`` of a report (one file, read in order)."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "line")) \
        .select(F.col("line_no").cast("long").alias("line_no"), "line")

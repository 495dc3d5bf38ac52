"""The driver's parquet tables mapped onto the labelled-text data model.

The corpus files of the original project are absent; the driver tables play
their roles (see README).  Every view here is a lazy DataFrame over the
parquet scans, so filters and column pruning reach the files.

The same views exist as SQL text in ``textlab.plans.sqlparts`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ENSEMBLE_WEIGHTS, MEMBER_SHAPE, PCL_CATEGORIES
from ..functions.text import SENTENCE_PATTERN
from ..operators.common import attach


#: Session setting: how many partitions text scans are dealt into.  Unset (the
#: default, and right on a cluster) no exchange is added.  The bench and the
#: tests set it, because their one-file tables would be read by one task.
SCAN_PARTITIONS_CONF = "textlab.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The scan of a table whose texts are read; dealt out evenly (round robin)
    only where ``textlab.scan.partitions`` asks for it."""
    df = table(spark, sf_dir, name)
    partitions = spark.conf.get(SCAN_PARTITIONS_CONF, None)
    return df.repartition(int(partitions)) if partitions else df


def paragraphs(spark: SparkSession, sf_dir: str, derive: dict | None = None,
               with_text: bool = True) -> DataFrame:
    """par_id, art_id, keyword, country_code, text, label (ordinal 0-4).

    label >= 2 exactly when the document is toxic; the ordinal level inside
    each side comes from the id so the 0-4 scale is populated.

    ``derive`` maps new column names to expressions over the documents'
    ``text``; they are computed on the document side *before* the label join,
    and with ``with_text=False`` the text itself never crosses the shuffle
    (per-document work is done where the data sits, only narrow rows move).
    With ``derive`` the rows with a null text are dropped first (text
    statistics skip null texts); the cheap ``IS NOT NULL`` reaches the scan,
    and no filter ever references the expensive derived columns (Catalyst
    would push such a filter down and tokenise twice).
    """
    read = texts if derive or with_text else table
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if derive:
        d = d.where(F.col("text").isNotNull())
    extra = list((derive or {}).keys())
    if derive:
        d = d.select("*", *[expr.alias(name) for name, expr in derive.items()])
    if not with_text:
        d = d.drop("text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    label = F.when(F.col("toxic") == 1, F.lit(2) + (F.col("doc_id") % 3).cast("int")) \
             .otherwise((F.col("doc_id") % 2).cast("int"))
    cols = [F.col("doc_id").alias("par_id"),
            F.concat(F.lit("@@"), F.col("doc_id").cast("string")).alias("art_id"),
            F.col("source").alias("keyword"),
            F.col("lang").alias("country_code")]
    if with_text:
        cols.append(F.col("text"))
    cols.append(label.cast("int").alias("label"))
    return d.join(lab, "doc_id").select(*cols, *extra)


def filed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph file with its position column ``pos``; every seventh id
    occurs twice, the second time with another text (the driver's ids are unique)."""
    p = paragraphs(spark, sf_dir)
    again = p.where(F.col("par_id") % 7 == 0).withColumn("text", F.concat(F.lit("copy of "), "text"))
    return (p.withColumn("pos", F.col("par_id") * 2)
            .unionByName(again.withColumn("pos", F.col("par_id") * 2 + 1)))


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label: the unlabelled test set, ``pos`` = id order."""
    d = texts(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_anti").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("@@"), F.col("doc_id").cast("string")).alias("art_id"),
        F.col("source").alias("keyword"),
        F.col("lang").alias("country_code"),
        F.col("text"),
        F.col("doc_id").alias("pos"),
    )


def dev_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The official dev list: labelled documents of quality 0.

    par_id, label as a multi-label string, pos = list order (by id).
    """
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lab.where(F.col("quality") == 0).select(
        F.col("doc_id").alias("par_id"),
        F.concat(F.lit("[0, "), F.col("toxic").cast("string"), F.lit(", 0]")).alias("label"),
        F.col("doc_id").alias("pos"),
    )


def span_rows(p: DataFrame) -> DataFrame:
    """Every sentence of every paragraph of ``p``, with 0-based half-open offsets.

    ``text[span_start:span_finish] == span_text``.  The sentences are cut once a
    text; an offset is the running length of the sentences before, by a window
    over the paragraph's own rows, so the work grows linearly with them.
    """
    lead = F.length(F.regexp_extract(F.col("text"), r"^[.!?]*", 0))
    sents = (p.select("par_id", lead.alias("lead"),
                      F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(SENTENCE_PATTERN), 0)).alias("pos", "s")))
    before = Window.partitionBy("par_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("lead") + F.coalesce(F.sum(F.length("s")).over(before), F.lit(0))
    cats = F.array(*[F.lit(c) for c in PCL_CATEGORIES])
    return sents.select(
        "par_id", "pos", start.cast("int").alias("span_start"),
        (start + F.length("s")).cast("int").alias("span_finish"), F.col("s").alias("span_text"),
        F.element_at(cats, ((F.col("par_id") + F.col("pos")) % 7 + 1).cast("int")).alias("pcl_category"),
        (F.lit(1) + F.col("pos") % 2).cast("int").alias("num_annotators"))


def spans(spark: SparkSession, sf_dir: str, part_bytes: int | None = None) -> DataFrame:
    """Span table: every sentence of a positive paragraph is one span, with the
    paragraph's own columns beside it.

    A span row repeats its paragraph's text, so the table is many times its paragraphs.
    ``part_bytes``: the paragraphs are first dealt out by id, into as many parts as keep
    a part's span rows near that size (for files that one task writes and one reads)."""
    p = paragraphs(spark, sf_dir).where(F.col("label") >= 2)
    if part_bytes:
        size = F.octet_length("text").cast("long") * F.size(F.regexp_extract_all("text", F.lit(SENTENCE_PATTERN), 0))
        parts = -(-(p.agg(F.sum(size)).first()[0] or 0) // part_bytes)
        p = p.repartition(max(parts, spark.sparkContext.defaultParallelism), "par_id")
    return (p.select("par_id", "art_id", "text", "keyword", "country_code")
            .join(span_rows(p), "par_id").drop("pos")
            .select("par_id", "art_id", "text", "keyword", "country_code", "span_start", "span_finish",
                    "span_text", "pcl_category", "num_annotators"))


def span_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``par_id, pos, n_chars, pcl_category, num_annotators`` of every span: no offsets, no window."""
    p = paragraphs(spark, sf_dir).where(F.col("label") >= 2)
    cats = F.array(*[F.lit(c) for c in PCL_CATEGORIES])
    s = p.select("par_id", F.posexplode(F.regexp_extract_all(F.col("text"), F.lit(SENTENCE_PATTERN), 0)).alias("pos", "s"))
    return s.select("par_id", "pos", F.col("s").alias("span_text"),
                    F.element_at(cats, ((F.col("par_id") + F.col("pos")) % 7 + 1).cast("int")).alias("pcl_category"),
                    (F.lit(1) + F.col("pos") % 2).cast("int").alias("num_annotators"))


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").select("page_id", "html")


def member_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table ``(par_id, model, z0, z1)`` for the three catalogue members.

    Deterministic logits derived from each labelled row: a label term of
    member-specific strength plus an id-derived disturbance, so members agree
    and disagree like real classifiers do.  Rows of real models trained with
    ``textlab.operators.ml`` have the same shape.
    """
    p = paragraphs(spark, sf_dir, with_text=False).select("par_id", "label")
    y = (F.col("label") >= 2).cast("double")
    members = []
    for model, (strength, mult) in zip(ENSEMBLE_WEIGHTS, MEMBER_SHAPE):
        noise = ((F.col("par_id") * mult) % 97 - 48).cast("double") / 24.0
        members.append(F.struct(F.lit(model).alias("model"), F.lit(0.0).alias("z0"),
                                ((y * 2.0 - 1.0) * strength + noise).alias("z1")))
    # one pass over the labelled rows, one output row per member
    return p.select("par_id", F.inline(F.array(*members)))


def open_member_logits(spark: SparkSession, sf_dir: str, members: int) -> DataFrame:
    """``(par_id, model, z0, z1)`` for ``members`` members named ``member_1`` and on: the stand-in for
    the outputs of an open model list, derived like :func:`member_logits`."""
    p = paragraphs(spark, sf_dir, with_text=False).select("par_id", "label")
    i = F.col("i")
    sign = (F.col("label") >= 2).cast("double") * 2.0 - 1.0
    noise = ((F.col("par_id") * (F.lit(17) + i * 6)) % 97 - 48).cast("double") / 24.0
    return (p.select("par_id", "label", F.explode(F.sequence(F.lit(1), F.lit(members))).alias("i"))
            .select("par_id", F.concat(F.lit("member_"), i.cast("string")).alias("model"),
                    F.lit(0.0).alias("z0"), (sign * i / 5.0 + noise).alias("z1")))


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(par_id, y)`` binary gold labels of the labelled rows."""
    return paragraphs(spark, sf_dir, with_text=False).select(
        "par_id", (F.col("label") >= 2).cast("int").alias("y"))


def embeddings_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-class rows ``(vec_id, z ARRAY<DOUBLE>, y)``: logit k is the dot product
    of the whole embedding with the mean vector of class k, rounded so that the
    order of a sum does not show; ``label`` is the truth.

    The means are one array of K vectors (classes x width, never table-sized),
    attached as a scalar; the rows themselves are not shuffled.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("y"))
    per_dim = (e.select("y", F.posexplode("embedding").alias("dim", "v"))
               .groupBy("y", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m")))
    vectors = per_dim.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("dim", "m")))["m"].alias("mean"))
    means = vectors.agg(F.sort_array(F.collect_list(F.struct("y", "mean")))["mean"].alias("means"))
    dot = F.transform("means", lambda m: F.round(F.aggregate(
        F.zip_with("embedding", m, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x), 6))
    return attach(e, means).select("vec_id", dot.alias("z"), "y")

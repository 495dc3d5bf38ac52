"""Data preparation: null handling, casts, de-duplication, the official
train/dev allocation, the stratified split, samples and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HOLDOUT_SHARE, SPLIT_SEED, VAL_SHARE_OF_HOLDOUT
from ..functions.labels import binarise, parse_multilabel
from ..functions.text import clean_text
from .common import attach


def drop_missing(df: DataFrame, subset=("text", "label")) -> DataFrame:
    return df.dropna(subset=list(subset))


def fill_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.fillna({col: ""})


def dedup_by_key(df: DataFrame, key: str, order: str, keep: str = "first") -> DataFrame:
    """One row per ``key``: the first (or last) by ``order``, a position column
    that tells the rows of a key apart.

    Only (key, position) is aggregated, by hash and before the shuffle, so a key
    holding a third of all rows becomes one row a task; the rows themselves are
    then fetched by a semi join.
    """
    if order == key:
        raise ValueError("the order column must tell the rows of a key apart")
    pick = F.min if keep == "first" else F.max
    at = df.groupBy(F.col(key).alias("_k")).agg(pick(order).alias("_at"))
    return df.join(at, df[key].eqNullSafe(F.col("_k")) & (df[order] == F.col("_at")), "left_semi")


def official_train(paragraphs: DataFrame, dev: DataFrame, key: str = "par_id") -> DataFrame:
    """Labelled rows whose id is not on the dev list (left anti join; Spark
    broadcasts the dev ids only when their measured size allows it)."""
    return paragraphs.join(dev.select(key), key, "left_anti")


def text_by_id(paragraphs: DataFrame, key: str = "par_id", keep: str = "first",
               pos: str = "pos") -> DataFrame:
    """``(key, text)`` with cleaned text, one row per id: the first (or last) of
    the file, by its position column."""
    t = paragraphs.where(F.col(key).isNotNull()).select(key, pos, "text")
    return dedup_by_key(t, key, pos, keep).select(
        key, clean_text(F.coalesce(F.col("text"), F.lit(""))).alias("text"))


def official_dev(dev: DataFrame, paragraphs: DataFrame, key: str = "par_id") -> DataFrame:
    """Dev rows in list order with their cleaned text ('' when the id is
    unknown; of a repeated id the first of the file) and binary label parsed
    from the multi-label string.  Duplicate list entries stay."""
    # only ids on the dev list are cleaned and de-duplicated (semi join first)
    texts = text_by_id(paragraphs.join(dev.select(key), key, "left_semi"), key)
    return dev.join(texts, key, "left").select(
        "pos", key, F.coalesce(F.col("text"), F.lit("")).alias("text"),
        parse_multilabel("label").alias("label"))


def strict_lookup(dev: DataFrame, paragraphs: DataFrame, key: str = "par_id") -> DataFrame:
    """Dev rows joined to their text (of a repeated id the last of the file);
    an id without text raises an error."""
    texts = text_by_id(paragraphs.where(F.col("text").isNotNull()).join(dev.select(key), key, "left_semi"),
                       key, "last")
    j = dev.join(texts, key, "left")
    checked = F.when(F.col("text").isNull(),
                     F.raise_error(F.concat(F.lit("unknown id: "), F.col(key).cast("string")))
                     ).otherwise(F.col("text"))
    return j.select("pos", key, checked.cast("string").alias("text"))


def official_split(paragraphs: DataFrame, dev: DataFrame, key: str = "par_id",
                   filed: DataFrame | None = None) -> DataFrame:
    """Train rows off the dev list and dev rows in list order.  ``filed`` is the
    paragraph file with its position column, for the dev texts (``paragraphs``
    itself where it has one)."""
    train = official_train(paragraphs.where(F.col("text").isNotNull() & F.col("label").isNotNull()), dev, key) \
        .select(F.lit("train").alias("split"), key, clean_text("text").alias("text"),
                binarise("label").alias("label"))
    dv = official_dev(dev, paragraphs if filed is None else filed, key).select(F.lit("dev").alias("split"), key, "text", "label")
    return train.unionByName(dv)


def stratified_split(df: DataFrame, key: str = "par_id", label: str = "label",
                     seed: int = SPLIT_SEED, holdout: float = HOLDOUT_SHARE,
                     val_share: float = VAL_SHARE_OF_HOLDOUT, hex_digits: int = 4,
                     carry: tuple[str, ...] = (), copies: str | None = None) -> DataFrame:
    """Exact stratified train / val / test assignment; ``carry`` columns stay on
    their rows.

    Inside each class, rows are ordered by ``md5('<seed>:' || key)``; the first
    ``floor(holdout * n + 0.5)`` rows are held out, the first half (floor) of
    those is ``val``, the rest ``test``.  This equals a ``row_number`` over the
    whole class, but no task ever ranks a whole class:

    1. the hash prefix puts each row in one of 16**hex_digits buckets;
    2. counts per (class, bucket) form a table bounded by 2 * 16**hex_digits
       rows; running sums on it give every bucket's first rank;
    3. buckets wholly inside one part are assigned through a broadcast join
       with that bounded table; only the at most two buckets per class that
       straddle a cut are ranked.  Where ids repeat, ``copies`` names a column
       that tells the copies apart: they are dealt over 64 windows an id.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.select(key, *carry, binarise(label).alias("binary_label"), h.alias("_h"),
                     F.pmod(F.xxhash64(copies or key), F.lit(64)).cast("int").alias("_s"),
                     F.xxhash64(copies or key).alias("_o"),
                     F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("long").alias("_b"))
    per_bucket = rows.groupBy("binary_label", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wc = Window.partitionBy("binary_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_class = per_bucket.groupBy("binary_label").agg(F.sum("_cnt").alias("_n"))
    hq = F.floor(F.col("_n") * holdout + 0.5)
    bt = (per_bucket.withColumn("_lo", F.coalesce(F.sum("_cnt").over(wc), F.lit(0)))
          .join(per_class, "binary_label")
          .withColumn("_hq", hq).withColumn("_vq", F.floor(hq * val_share))
          .withColumn("_hi", F.col("_lo") + F.col("_cnt")))
    status = (F.when(F.col("_hi") <= F.col("_vq"), "val")
              .when((F.col("_lo") >= F.col("_vq")) & (F.col("_hi") <= F.col("_hq")), "test")
              .when(F.col("_lo") >= F.col("_hq"), "train").otherwise("mixed"))
    bt = bt.select("binary_label", "_b", "_lo", "_vq", "_hq", status.alias("_st"))
    j = rows.join(F.broadcast(bt), ["binary_label", "_b"])
    whole = j.where(F.col("_st") != "mixed").select(key, *carry, "binary_label", F.col("_st").alias("split"))
    # Straddling buckets: counts per (id, window) give every window its first
    # rank, a row number inside the window the rest.
    mixed = j.where(F.col("_st") == "mixed")
    one = ["binary_label", "_b", "_h", key, "_s"]
    sizes = mixed.groupBy(*one).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("binary_label", "_b").orderBy("_h", key, "_s") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*one, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*one).orderBy("_o")
    rank = F.col("_lo") + F.col("_from") + F.col("_r")
    split = (F.when(rank <= F.col("_vq"), "val").when(rank <= F.col("_hq"), "test").otherwise("train"))
    ranked = (mixed.withColumn("_r", F.row_number().over(inside)).join(sizes, one)
              .select(key, *carry, "binary_label", split.alias("split")))
    return whole.unionByName(ranked)


def sample_docs(df: DataFrame, n: int = 1000, key: str = "par_id", seed: int = SPLIT_SEED) -> DataFrame:
    """Fixed-size deterministic sample: the rows of the n smallest hash keys.

    Counts per hash prefix (at most 65,536) tell which prefixes can hold the
    sample; only the ids under them are ranked, and texts are fetched for the n
    chosen ids alone.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ids = df.select(key, h.alias("_h"), F.conv(F.substring(h, 1, 4), 16, 10).cast("long").alias("_b"))
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("_sum", F.sum("_c").over(upto))
    last = reached.agg(F.coalesce(F.min(F.when(F.col("_sum") >= n, F.col("_b"))), F.max("_b")).alias("_last"))
    chosen = attach(ids, last).where(F.col("_b") <= F.col("_last")).orderBy("_h", key).limit(n).select(key)
    return df.join(chosen, key, "left_semi")


def split_leakage(parts: DataFrame, key: str = "par_id", train: str = "train", text_key: str = "text_key") -> DataFrame:
    """Training rows whose cleaned text also occurs in a held-out part: semi join
    on the content hash that the split rows carry."""
    held = parts.where(F.col("split") != train).select(text_key).distinct()
    return (parts.where(F.col("split") == train).join(held, text_key, "left_semi")
            .select(key, "binary_label"))


def class_weights(df: DataFrame, label: str = "label", weights=(1.0, 9.0)) -> DataFrame:
    y = binarise(label)
    return df.select("par_id", y.alias("binary_label"),
                     F.when(y == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])).alias("weight"))

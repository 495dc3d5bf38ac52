"""Class-weighted multinomial naive Bayes as counts and one join.

A model is a table ``term, f0, f1`` of token counts by class with one row of
totals; nothing is fitted by a library.  Class ``c`` with weight ``w_c`` has ::

    ln p(t | c) = ln (w_c f_tc + alpha) - ln (w_c N_c + alpha V)
    ln p(c)     ~ ln (w_c n_c + alpha)

so a document's margin is the difference of the priors plus, for every token
of the vocabulary, the difference of the term terms.  Several settings of
(class weights, alpha) are weighed and scored together: a term carries one
number a setting.  The numbers are decimals with nine places, so sums do not
depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS
from ..functions.text import content_tokens, tokenize
from .common import attach, r6, stored

PLACES = 9
#: Vocabularies up to this many terms are broadcast to the documents (under 100 MB).
BROADCAST_TERMS = 1_000_000
_TERM = f"decimal(12,{PLACES})"


class Setting(NamedTuple):
    """One setting of the model."""
    weight0: float = CLASS_WEIGHTS[0]
    weight1: float = CLASS_WEIGHTS[1]
    alpha: float = 1.0


def terms_of(text: str = "text") -> Column:
    """The content tokens of a text, none for a null one."""
    return content_tokens(tokenize(F.coalesce(F.col(text), F.lit(""))))


def document_terms(rows: DataFrame, *keep: str, tokens: Column | None = None) -> DataFrame:
    """``keep, term``: one row a token; documents without one have none.  ``tokens``: an array
    column, the content tokens of ``text`` where it is not given."""
    # outer: an inner explode would infer a filter on the array, and tokenise for it once more
    return (rows.select(*keep, (terms_of() if tokens is None else tokens).alias("_t"))
            .select(*keep, F.explode_outer("_t").alias("term")).where(F.col("term").isNotNull()))


def class_counts(train: DataFrame, label: str = "label", tokens: Column | None = None) -> DataFrame:
    """``term, f0, f1``: how often each class has the term (counted before the shuffle)."""
    y = F.col(label) == 1
    return (document_terms(train, label, tokens=tokens).groupBy("term")
            .agg(F.sum((~y).cast("long")).alias("f0"), F.sum(y.cast("long")).alias("f1")))


def totals(counts: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """One row: documents ``n0, n1``, tokens ``t0, t1`` by class and the size ``v`` of the vocabulary."""
    y = F.col(label) == 1
    docs = train.agg(F.coalesce(F.sum((~y).cast("long")), F.lit(0)).alias("n0"),
                     F.coalesce(F.sum(y.cast("long")), F.lit(0)).alias("n1"))
    tokens = counts.agg(F.coalesce(F.sum("f0"), F.lit(0)).alias("t0"), F.coalesce(F.sum("f1"), F.lit(0)).alias("t1"),
                        F.count(F.lit(1)).alias("v"))
    return attach(docs, tokens)


def _nine(value: Column) -> Column:
    return F.round(value, PLACES).cast(_TERM)


def _term_terms(s: Setting) -> Column:
    one, nil = (F.log((F.lit(w) * F.col(f).cast("double") + F.lit(s.alpha))
                      / (F.lit(w) * F.col(t).cast("double") + F.lit(s.alpha) * F.col("v").cast("double")))
                for w, f, t in ((s.weight1, "f1", "t1"), (s.weight0, "f0", "t0")))
    return _nine(one - nil)


def _prior(s: Setting) -> Column:
    one, nil = (F.log(F.lit(w) * F.col(n).cast("double") + F.lit(s.alpha))
                for w, n in ((s.weight1, "n1"), (s.weight0, "n0")))
    return _nine(one - nil)


def term_weights(counts: DataFrame, total: DataFrame, settings: Sequence[Setting] = (Setting(),)) -> DataFrame:
    """``term, f0, f1, llr``: the array ``llr`` holds a term's weight for every setting."""
    return attach(counts, total).select("term", "f0", "f1", F.array(*[_term_terms(s) for s in settings]).alias("llr"))


def margins(docs: DataFrame, weights: DataFrame, total: DataFrame, settings: Sequence[Setting] = (Setting(),),
            keep: Sequence[str] = ("par_id",), tokens: Column | None = None) -> DataFrame:
    """``keep, margin``: log-odds of class 1 for every row of ``docs``, an array with one entry a setting.

    ``keep`` must tell the rows apart.  Tokens that training has not seen add
    nothing, so a document without a known term has the priors' margin.
    """
    # tokens meet the weights where they are (one row a term, broadcast while few), and are summed there
    sums = [F.sum(F.col("llr")[i]).alias(f"s{i}") for i in range(len(settings))]
    known = document_terms(docs, *keep, tokens=tokens).join(_small(weights.select("term", "llr")), "term").groupBy(*keep).agg(*sums)
    none = F.lit(0).cast(_TERM)
    entry = [(F.col(f"p{i}") + F.coalesce(F.col(f"s{i}"), none)).cast("double") for i in range(len(settings))]
    prior = total.select(*[_prior(s).alias(f"p{i}") for i, s in enumerate(settings)])
    return attach(docs.select(*keep).join(known, list(keep), "left"), prior).select(*keep, F.array(*entry).alias("margin"))


def _small(weights: DataFrame) -> DataFrame:
    """``weights``, to be broadcast where the vocabulary is small."""
    return F.broadcast(weights) if weights.count() <= BROADCAST_TERMS else weights


def bayes_scores(train: DataFrame, docs: DataFrame, setting: Setting = Setting(), keep: Sequence[str] = ("par_id",)) -> DataFrame:
    """``keep, margin, p, pred`` of every row of ``docs`` by the model of ``train``."""
    counts = stored(class_counts(train), "class-counts")
    total = stored(totals(counts, train), "class-totals")
    m = margins(docs, term_weights(counts, total, (setting,)), total, (setting,), keep)
    z = F.col("margin")[0]
    return m.select(*keep, r6(z).alias("margin"), r6(F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("p"),
                    (z > 0).cast("int").alias("pred"))

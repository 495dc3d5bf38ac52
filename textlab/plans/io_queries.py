"""Source / sink queries: driver rows written as the corpus' file formats to
the shared scratch folder, read back with the corpus readers and returned;
plus the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CLASS_WEIGHTS, ENSEMBLE_THRESHOLD, ENSEMBLE_WEIGHTS, MAX_LENGTH
from ..operators import lengths as LN
from ..operators import lexical as L
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import report as R
from ..sources import delimited as IO
from ..sources import driver as D
from ..session import scratch_path
from .registry import ORACLE, query
from .sqlparts import DEV, PARA, TOK, UNLAB, clean_of
from . import scoring_queries as SQ  # noqa: F401  (registers the metric queries first)
from . import lexical_queries as LQ  # noqa: F401
from . import length_queries as LNQ  # noqa: F401
from . import profile_queries as PQ  # noqa: F401


@query("scan_paragraphs", f"WITH {PARA}\nSELECT par_id, art_id, keyword, country_code, text, label FROM para")
def q_scan_paragraphs(spark, sf):
    path = scratch_path(spark, "paragraphs-tsv")
    IO.write_delimited(D.paragraphs(spark, sf), path)
    return IO.read_paragraph_tsv(spark, path, multi_line=True)


@query("scan_spans", f"""
WITH {PARA}, {PQ._SPANS}
SELECT par_id, art_id, text, keyword, country_code, span_start, span_finish, span_text, pcl_category,
       num_annotators FROM spans""")
def q_scan_spans(spark, sf):
    path = scratch_path(spark, "spans-tsv")
    IO.write_delimited(D.spans(spark, sf, IO.FILE_BYTES), path)
    return IO.read_span_tsv(spark, path, multi_line=True)


@query("scan_paragraphs_split", ORACLE["scan_paragraphs"])
def q_scan_paragraphs_split(spark, sf):
    """The paragraph file with a line a row, which large files are split by."""
    path = scratch_path(spark, "paragraphs-lines")
    IO.write_delimited(D.paragraphs(spark, sf), path, one_line=True)
    return IO.read_paragraph_tsv(spark, path, one_line=True)


@query("scan_spans_split", ORACLE["scan_spans"])
def q_scan_spans_split(spark, sf):
    path = scratch_path(spark, "spans-lines")
    IO.write_delimited(D.spans(spark, sf, IO.FILE_BYTES), path, one_line=True)
    return IO.read_span_tsv(spark, path, one_line=True)


@query("scan_dev_labels", f"WITH {DEV}\nSELECT par_id, label FROM dev")
def q_scan_dev_labels(spark, sf):
    path = scratch_path(spark, "dev-csv")
    IO.write_delimited(D.dev_labels(spark, sf).select("par_id", "label"), path, sep=",", header=True)
    return IO.read_dev_labels_csv(spark, path)


@query("scan_unlabelled", f"WITH {UNLAB}\nSELECT id, art_id, keyword, country_code, text FROM unlab")
def q_scan_unlabelled(spark, sf):
    path = scratch_path(spark, "unlabelled-tsv")
    IO.write_delimited(D.unlabelled(spark, sf).drop("pos"), path)
    return IO.read_unlabelled_tsv(spark, path, multi_line=True)


@query("submission_rows", f"""
WITH {SQ._BASE}, {DEV}
SELECT CAST(row_number() OVER (ORDER BY dev.pos) - 1 AS BIGINT) AS line_no, vote.pred
FROM dev JOIN vote USING (par_id)""")
def q_submission_rows(spark, sf):
    vote = SQ._vote(spark, sf)
    preds = D.dev_labels(spark, sf).join(vote, "par_id").select("pos", "pred")
    path = scratch_path(spark, "dev-predictions")
    IO.write_predictions(preds, path)
    return IO.read_predictions(spark, path)


@query("misclassified_csv", f"""
WITH {SQ._BASE}
SELECT p.text, ev.y AS true_label, ev.pred AS predicted_label, ev.ensemble_score
FROM ev JOIN para p USING (par_id) WHERE ev.pred <> ev.y""")
def q_misclassified_csv(spark, sf):
    path = scratch_path(spark, "misclassified-csv")
    IO.write_misclassified(SQ.q_misclassified(spark, sf), path)
    return IO.read_misclassified(spark, path)


@query("misclassified_split_csv", ORACLE["misclassified_csv"])
def q_misclassified_split_csv(spark, sf):
    path = scratch_path(spark, "misclassified-lines")
    IO.write_misclassified(SQ.q_misclassified(spark, sf), path, one_line=True)
    return IO.read_misclassified(spark, path, one_line=True)


@query("misclassified_plain_csv", f"""
WITH {SQ._BASE}
SELECT replace(replace(p.text, chr(10), ' '), ',', ' ') AS text, ev.y AS true_label, ev.pred AS predicted_label,
       round(ev.ensemble_score, 4) AS ensemble_score
FROM ev JOIN para p USING (par_id) WHERE ev.pred <> ev.y""")
def q_misclassified_plain_csv(spark, sf):
    path = scratch_path(spark, "misclassified-plain-csv")
    IO.write_misclassified(IO.plain_errors(SQ.q_misclassified(spark, sf)), path)
    return IO.read_misclassified(spark, path, multi_line=False)


def _melt_sql(sql: str, section: str, cols, id_col: str | None = None, section_expr: str | None = None) -> str:
    parts = []
    for c in cols:
        item = f"'{c}'" if id_col is None else f"CAST({id_col} AS VARCHAR) || ':{c}'"
        sec = section_expr or f"'{section}'"
        parts.append(f"SELECT {sec} AS section, {item} AS item, CAST({c} AS DOUBLE) AS value FROM ({sql}) AS s_{c}")
    return "\nUNION ALL ".join(parts)


def _eval_report_sql() -> str:
    conf = [f"SELECT 'configuration' AS section, 'weight:{m}' AS item, {w}::DOUBLE AS value"
            for m, w in ENSEMBLE_WEIGHTS.items()]
    conf += [f"SELECT 'configuration', 'threshold', {ENSEMBLE_THRESHOLD}::DOUBLE",
             f"SELECT 'configuration', 'class_weight_pos', {CLASS_WEIGHTS[1]}::DOUBLE",
             f"SELECT 'configuration', 'max_length', {MAX_LENGTH}::DOUBLE",
             f"SELECT 'configuration', 'eval_samples', CAST(count(*) AS DOUBLE) FROM (WITH {SQ._BASE} SELECT * FROM ev)"]
    models = _melt_sql(ORACLE["binary_metrics"], "", ["accuracy", "precision", "recall", "f1"], id_col="model",
                       section_expr="CASE WHEN model = 'Ensemble' THEN 'ensemble' ELSE 'model' END")
    reports = _melt_sql(ORACLE["classification_reports"], "", ["precision", "recall", "f1", "support"], id_col="item",
                        section_expr="'report ' || model")
    errs = _melt_sql(ORACLE["error_rate"], "summary", ["n_errors", "error_pct"])
    return "\nUNION ALL ".join(conf + [models, reports, errs])


@query("evaluation_report", _eval_report_sql())
def q_evaluation_report(spark, sf):
    preds = SQ._all_preds(spark, sf)
    ens = SQ._ens_preds(spark, sf)
    return R.evaluation_report(M.binary_metrics(preds, "model"), ens.agg(F.count(F.lit(1)).alias("n")),
                               M.error_rate(ens), M.classification_report(preds, by="model"))


def _eda_report_sql() -> str:
    return "\nUNION ALL ".join([
        _melt_sql(ORACLE["class_imbalance"], "class_balance",
                  ["n_total", "n_non_pcl", "n_pcl", "pct_non_pcl", "pct_pcl", "imbalance_ratio"]),
        _melt_sql(ORACLE["length_summary"], "lengths",
                  ["median_tokens", "mean_tokens", "p95_all", "p95_pcl", "max_tokens"]),
        _melt_sql(ORACLE["class_vocab_stats"], "lexical", ["vocab_size", "n_tokens"], id_col="binary_label"),
        _melt_sql(ORACLE["length_percentiles"], "percentiles", ["all_docs", "pcl", "non_pcl"],
                  id_col="percentile"),
        _melt_sql(ORACLE["distinctive_terms"], "distinctive", ["log_odds", "pcl_freq", "non_pcl_freq"],
                  id_col="side || ':' || term"),
        _melt_sql(ORACLE["top_bigrams"], "bigrams", ["freq"], id_col="binary_label || ':' || ngram"),
        _melt_sql(ORACLE["rate_by_keyword"], "keywords", ["pcl_rate", "pcl_count", "total"], id_col="keyword"),
        _melt_sql(ORACLE["table_shapes"], "tables", ["n_rows", "n_cols"], id_col="table_name"),
    ])


@query("eda_report", _eda_report_sql())
def q_eda_report(spark, sf):
    counts = R.exploration_counts(D.paragraphs(spark, sf))
    lt, freq = R.length_part(counts), R.term_part(counts)
    return R.eda_report(P.class_imbalance(D.paragraphs(spark, sf, with_text=False)),
                        LN.length_summary(lt), L.class_vocab_stats(freq), LN.length_percentiles(lt),
                        L.distinctive_terms(L.log_odds(freq)), R.bigram_part(counts),
                        PQ.q_rate_by_keyword(spark, sf), PQ.q_table_shapes(spark, sf))


def _report_file_sql(report: str, title: str) -> str:
    return f"""
WITH r AS ({report}),
l AS (SELECT 0 AS o, '' AS section, '' AS item, '# {title}' AS line
      UNION ALL SELECT 1, '', '', '| section | item | value |' UNION ALL SELECT 2, '', '', '|---|---|---|'
      UNION ALL SELECT 3, section, item,
                '| ' || section || ' | ' || item || ' | ' || coalesce(printf('%.6f', value), '') || ' |' FROM r)
SELECT CAST(row_number() OVER (ORDER BY o, section, item) - 1 AS BIGINT) AS line_no, line FROM l"""


@query("eda_report_file", _report_file_sql(_eda_report_sql(), "Exploration"))
def q_eda_report_file(spark, sf):
    """The exploration report written as a text file and read back line by line."""
    path = scratch_path(spark, "eda-report")
    IO.write_report(q_eda_report(spark, sf), path, "Exploration")
    return IO.read_report(spark, path)


@query("evaluation_report_file", _report_file_sql(_eval_report_sql(), "Evaluation"))
def q_evaluation_report_file(spark, sf):
    """The evaluation report written as a text file and read back line by line."""
    path = scratch_path(spark, "evaluation-report")
    IO.write_report(q_evaluation_report(spark, sf), path, "Evaluation")
    return IO.read_report(spark, path)


@query("stream_clean_pages", f"""
SELECT page_id, {clean_of('html')} AS clean, CAST(len(regexp_extract_all(lower({clean_of('html')}), {TOK})) AS BIGINT) AS n_tokens
FROM pages""")
def q_stream_clean_pages(spark, sf):
    """The page cleaner run as a Structured Streaming job (file source ->
    stateless transform -> parquet sink with checkpoint), result read back."""
    from ..streaming import pipeline as SP
    out = scratch_path(spark, "stream-out")
    cleaned = SP.clean_pages(SP.read_table_stream(spark, sf, "pages", SP.PAGES_SCHEMA))
    SP.run_to_parquet(cleaned, out, scratch_path(spark, "stream-ckpt"))
    return spark.read.schema(cleaned.schema).parquet(out)

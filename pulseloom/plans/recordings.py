"""Queries over beats and seizures, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import is_seizure, run_number, subject_id
from pulseloom.operators import features, labels, tachogram, windows
from pulseloom.sources.files import matched
from pulseloom.sources.fixtures import BEATS_SQL, EVENTS_SQL, SEIZURES_SQL, beats, events, seizures, table

_B = f"WITH {BEATS_SQL}"
_BZ = f"{_B}, {SEIZURES_SQL.format(keys="user_id // 15")}"
_DENSE = SEIZURES_SQL.format(keys="user_id // 15, event_type")
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can express it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# -- tachograms ------------------------------------------------------------------------


@query(f"""{_B} SELECT rec, count(*) + 1 AS n_peaks, count(*) AS n_rr, count(*) FILTER (rr_ms NOT BETWEEN 200 AND 2000) AS n_artifacts,
  round(count(*) FILTER (rr_ms NOT BETWEEN 200 AND 2000) / count(*), 6) AS artifact_rate,
  round(avg(rr_ms) FILTER (rr_ms BETWEEN 200 AND 2000), 6) AS mean_rr_ms,
  round(stddev_pop(rr_ms) FILTER (rr_ms BETWEEN 200 AND 2000), 6) AS std_rr_ms,
  round(60000 / avg(rr_ms) FILTER (rr_ms BETWEEN 200 AND 2000), 6) AS mean_hr FROM beats GROUP BY rec""")
def tachogram_stats(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.stats(beats(spark, d))


@query(f"""{_B}, p AS (SELECT rec, beat_idx, t_ms * 256 // 1000 AS sample FROM beats)
SELECT * FROM (SELECT rec, beat_idx, round((sample - lag(sample) OVER (PARTITION BY rec ORDER BY beat_idx)) / 256, 6) AS rr_s, round(sample / 256, 6) AS t_s FROM p)
WHERE rr_s IS NOT NULL""")
def rr_from_peaks(spark: SparkSession, d: str) -> DataFrame:
    peaks = beats(spark, d).select("rec", "beat_idx", F.expr("t_ms * 256 div 1000").alias("sample"))
    return tachogram.rr_from_peaks(peaks, 256.0).select("rec", "beat_idx", *r6("rr_s", "t_s"))


@query(f"{_B} SELECT rec, beat_idx, rr_ms, t_ms, rr_ms NOT BETWEEN 200 AND 2000 AS is_artifact FROM beats")
def rr_artifact_threshold(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.with_artifacts(beats(spark, d))


@query(f"""{_B}, m AS (SELECT rec, median(rr_ms) AS med FROM beats GROUP BY rec), s AS (SELECT b.rec, any_value(med) AS med, median(abs(rr_ms - med)) AS mad FROM beats b JOIN m USING (rec) GROUP BY b.rec)
SELECT b.rec, beat_idx, rr_ms, t_ms, abs(rr_ms - med) > 3 * mad AS is_artifact FROM beats b JOIN s USING (rec)""")
def rr_artifact_mad(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.with_artifacts(beats(spark, d), "mad")


_Q = "q AS (SELECT rec, quantile_cont(rr_ms, 0.25) AS q1, quantile_cont(rr_ms, 0.75) AS q3, count(*) AS n FROM beats GROUP BY rec)"


@query(f"""{_B}, {_Q} SELECT b.rec, beat_idx, rr_ms, t_ms, rr_ms < q1 - 1.5 * (q3 - q1) OR rr_ms > q3 + 1.5 * (q3 - q1) AS is_artifact FROM beats b JOIN q USING (rec)""")
def rr_artifact_iqr(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.with_artifacts(beats(spark, d), "iqr")


@query(f"""{_B}, {_Q}, w AS (SELECT b.rec, beat_idx, t_ms, CASE WHEN rr_ms < q1 - 1.5 * (q3 - q1) THEN q1 WHEN rr_ms > q3 + 1.5 * (q3 - q1) THEN q3 ELSE rr_ms END AS rr_w FROM beats b JOIN q USING (rec))
SELECT rec, beat_idx, CAST(rr_w AS DOUBLE) AS rr_w, CAST(first(t_ms) OVER (PARTITION BY rec ORDER BY beat_idx)
  + coalesce(sum(rr_w) OVER (PARTITION BY rec ORDER BY beat_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS t_w FROM w""")
def rr_winsorise(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.winsorised(beats(spark, d))


@query(f"""{_B}, c AS (SELECT rec, t_ms, rr_ms, row_number() OVER (PARTITION BY rec ORDER BY t_ms) AS k, count(*) OVER (PARTITION BY rec) AS n FROM clean),
j AS (SELECT b.rec, b.beat_idx, b.t_ms, b.rr_ms, b.rr_ms NOT BETWEEN 200 AND 2000 AS bad, (SELECT count(*) FROM c WHERE c.rec = b.rec AND c.t_ms < b.t_ms) AS k0 FROM beats b),
e AS (SELECT j.*, greatest(least(k0, (SELECT max(n) FROM c WHERE c.rec = j.rec) - 1), 1) AS ka FROM j)
SELECT e.rec, beat_idx, round(CASE WHEN NOT bad THEN e.rr_ms ELSE a.rr_ms + (e.t_ms - a.t_ms) * (z.rr_ms - a.rr_ms) / (z.t_ms - a.t_ms) END, 6) AS rr_i, e.t_ms, bad AS was_artifact
FROM e JOIN c a ON a.rec = e.rec AND a.k = ka JOIN c z ON z.rec = e.rec AND z.k = ka + 1""")
def rr_interp_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.interpolated(beats(spark, d)).select("rec", "beat_idx", *r6("rr_i"), "t_ms", "was_artifact")


@query(f"{_B} SELECT rec, beat_idx, t_ms AS t_sum FROM beats")
def cumulative_timeline(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.timeline(beats(spark, d))


@query(f"{_B} SELECT * FROM clean WHERE t_ms BETWEEN 600000 AND 1500000")
def time_segment(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.between(beats(spark, d).where(tachogram.physiologic()), 600000, 1500000)


@query(f"{_BZ}, f AS (SELECT rec, min(onset_s) AS onset FROM seizures GROUP BY rec) SELECT b.* FROM beats b JOIN f USING (rec) WHERE t_ms <= onset * 1000")
def truncate_at_seizure(spark: SparkSession, d: str) -> DataFrame:
    first = seizures(spark, d).groupBy("rec").agg(F.min("onset_s").alias("onset"))
    return beats(spark, d).join(first, "rec").where(F.col("t_ms") <= F.col("onset") * 1000).drop("onset")


@query(f"{_B} SELECT rec, beat_idx, round(rr_ms - avg(rr_ms) OVER (PARTITION BY rec), 6) AS x FROM beats")
def mean_removal(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.centred(beats(spark, d)).select("rec", "beat_idx", *r6("x"))


@query(f"""{_B}, l AS (SELECT rec, regr_slope(rr_ms, t_ms) AS m, regr_intercept(rr_ms, t_ms) AS c FROM beats GROUP BY rec)
SELECT b.rec, beat_idx, round(rr_ms - m * t_ms - c, 4) AS x FROM beats b JOIN l USING (rec)""")
def linear_detrend(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.detrended(beats(spark, d)).select("rec", "beat_idx", F.round("x", 4).alias("x"))


@query(f"""{_B}, h AS (SELECT rec, CAST(rr_ms AS DOUBLE) AS y, lead(t_ms) OVER (PARTITION BY rec ORDER BY beat_idx) - t_ms AS dt FROM beats)
SELECT rec, round(sum(y * dt) / sum(dt), 6) AS mean_tw, round(sum(y * y * dt) / sum(dt) - (sum(y * dt) / sum(dt)) ** 2, 4) AS var_tw FROM h WHERE dt IS NOT NULL GROUP BY rec""")
def time_weighted_var(spark: SparkSession, d: str) -> DataFrame:
    return tachogram.time_weighted(beats(spark, d)).select("rec", *r6("mean_tw"), F.round("var_tw", 4).alias("var_tw"))


# -- features of minutes ---------------------------------------------------------------


@query(f"{_B} SELECT rec, minute FROM grid")
def minute_grid(spark: SparkSession, d: str) -> DataFrame:
    return features.grid(beats(spark, d))


_W3 = """w AS (SELECT g.rec, g.minute, rr_ms, t_ms, rr_ms - lag(rr_ms) OVER (PARTITION BY g.rec, g.minute ORDER BY beat_idx) AS d
  FROM grid g JOIN clean c ON c.rec = g.rec AND c.t_ms BETWEEN (g.minute - {m}) * 60000 AND g.minute * 60000 WHERE g.minute >= {m})"""
_TIME_3 = f"""{_W3.format(m=3)}, time3 AS (SELECT rec, minute, count(*) AS n, round(avg(rr_ms), 6) AS RRMean_3, min(rr_ms) AS RRMin_3, max(rr_ms) AS RRMax_3, round(var_samp(rr_ms), 6) AS RRVar_3,
  round(sqrt(avg(d * d)), 6) AS RMSSD_3, round(stddev_samp(rr_ms), 6) AS SDNN_3, round(stddev_samp(d), 6) AS SDSD_3,
  count(*) FILTER (abs(d) > 50) AS NN50_3, round(count(*) FILTER (abs(d) > 50) * 100.0 / (count(*) - 1), 6) AS pNN50_3
  FROM w GROUP BY rec, minute HAVING count(*) >= 5)"""


@query(f"{_B}, {_TIME_3} SELECT * FROM time3")
def minute_time_3(spark: SparkSession, d: str) -> DataFrame:
    return features.time_domain(beats(spark, d))


_POIN = f"""{_W3.format(m=5).replace("w AS", "wp AS", 1)}, pp AS (SELECT rec, minute, rr_ms, d, CASE WHEN d IS NOT NULL THEN 2 * rr_ms - d END AS s FROM wp),
poin AS (SELECT rec, minute, count(*) AS n, round(stddev_samp(d) / sqrt(2), 6) AS SD1_5, round(stddev_samp(s) / sqrt(2), 6) AS SD2_5,
  round(CASE WHEN stddev_samp(s) > 0 THEN stddev_samp(d) / stddev_samp(s) ELSE 0 END, 6) AS SD1toSD2_5 FROM pp GROUP BY rec, minute HAVING count(*) >= 10)"""


@query(f"{_B}, {_POIN} SELECT * FROM poin")
def minute_poincare_5(spark: SparkSession, d: str) -> DataFrame:
    return features.poincare(beats(spark, d))


@query(f"""{_B}, c AS (SELECT rec, CAST(unnest([1000000, 2000500, 3000000, 30000000]) AS BIGINT) AS centre_ms FROM (SELECT DISTINCT rec FROM beats))
SELECT c.rec, centre_ms, count(b.rr_ms) AS n, CASE WHEN count(b.rr_ms) >= 5 THEN round(avg(b.rr_ms), 6) END AS mean_rr, CASE WHEN count(b.rr_ms) >= 5 THEN round(stddev_samp(b.rr_ms), 6) END AS sd_rr
FROM c LEFT JOIN clean b ON b.rec = c.rec AND b.t_ms BETWEEN centre_ms - 1500000 AND centre_ms GROUP BY c.rec, centre_ms""")
def centre_windows(spark: SparkSession, d: str) -> DataFrame:
    b = beats(spark, d)
    centres = b.select("rec").distinct().select("rec", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1000000, 2000500, 3000000, 30000000)])).alias("centre_ms"))
    return features.at_centres(b, centres, 25)


@query(f"""{_B}, {_TIME_3}, f AS (SELECT g.rec, g.minute, t.RRMean_3, t.SDNN_3, t.NN50_3 FROM grid g LEFT JOIN time3 t USING (rec, minute))
SELECT rec, minute, coalesce(RRMean_3, 0.0) AS RRMean_3, coalesce(SDNN_3, 0.0) AS SDNN_3, CAST(coalesce(NN50_3, 0) AS DOUBLE) AS NN50_3,
  CASE WHEN RRMean_3 IS NULL OR SDNN_3 IS NULL OR NN50_3 IS NULL THEN 0 ELSE 1 END AS mask,
  round((CAST(RRMean_3 IS NOT NULL AS INT) + CAST(SDNN_3 IS NOT NULL AS INT) + CAST(NN50_3 IS NOT NULL AS INT)) / 3, 6) AS mask_ratio FROM f""")
def feature_mask(spark: SparkSession, d: str) -> DataFrame:
    b = beats(spark, d)
    rows = features.grid(b).join(features.time_domain(b).select("rec", "minute", "RRMean_3", "SDNN_3", "NN50_3"), ["rec", "minute"], "left")
    return features.availability(rows, ["RRMean_3", "SDNN_3", "NN50_3"])


# -- labels ----------------------------------------------------------------------------

_STATUS = """z AS (SELECT g.rec, g.minute, g.minute * 60 AS t, s.idx, s.onset_s, s.dur_s, (s.onset_s <= g.minute * 60 AND g.minute * 60 < s.onset_s + s.dur_s) AS ict,
  (g.minute * 60 - s.onset_s BETWEEN 0 AND 1800) AS post, min(CASE WHEN s.onset_s <= g.minute * 60 AND g.minute * 60 < s.onset_s + s.dur_s THEN s.idx END) OVER (PARTITION BY g.rec, g.minute) AS fi
  FROM grid g LEFT JOIN seizures s USING (rec)),
a AS (SELECT rec, minute, CAST(max(fi) IS NOT NULL AS INTEGER) AS is_ictal, CAST(coalesce(bool_or(post AND (fi IS NULL OR idx < fi)), false) AS INTEGER) AS is_postictal, min(abs(onset_s - t)) / 60 AS away FROM z GROUP BY rec, minute),
b AS (SELECT *, CASE WHEN is_ictal = 0 AND is_postictal = 0 THEN CASE WHEN away < 5 THEN 1 WHEN away < 30 THEN 2 WHEN away < 60 THEN 3 ELSE 4 END ELSE 0 END AS bin FROM a),
status AS (SELECT rec, minute, CAST(bin = 1 AS INTEGER) AS bin_1, CAST(bin = 2 AS INTEGER) AS bin_2, CAST(bin = 3 AS INTEGER) AS bin_3, CAST(bin = 4 AS INTEGER) AS bin_4, is_ictal, is_postictal,
  is_postictal AS recent_seizure_flag, CAST(bin > 0 AS INTEGER) AS training_mask FROM b)"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    return labels.status(features.grid(beats(spark, d)), seizures(spark, d))


@query(f"{_BZ}, {_STATUS} SELECT * FROM status")
def seizure_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d)


@query(f"{_BZ} SELECT g.rec, g.minute, CAST(min(abs(onset_s - g.minute * 60)) AS BIGINT) AS nearest_s FROM grid g LEFT JOIN seizures s USING (rec) GROUP BY g.rec, g.minute")
def nearest_seizure(spark: SparkSession, d: str) -> DataFrame:
    return labels.nearest(features.grid(beats(spark, d)), seizures(spark, d))


@query(f"{_BZ} SELECT g.rec, g.minute, max(CASE WHEN onset_s <= g.minute * 60 AND g.minute * 60 < onset_s + dur_s THEN 1 ELSE 0 END) AS is_ictal FROM grid g LEFT JOIN seizures s USING (rec) GROUP BY g.rec, g.minute")
def ictal_interval(spark: SparkSession, d: str) -> DataFrame:
    return labels.ictal(features.grid(beats(spark, d)), seizures(spark, d))


@query(f"{_BZ}, {_STATUS} SELECT bin_1, bin_2, bin_3, bin_4, is_ictal, is_postictal, count(*) AS n FROM status GROUP BY ALL")
def proximity_bins(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).groupBy("bin_1", "bin_2", "bin_3", "bin_4", "is_ictal", "is_postictal").agg(F.count("*").alias("n"))


_VALID = f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY onset_s, idx) AS k FROM seizures),
v AS (SELECT rec, idx, onset_s, k, onset_s >= 1200 AS is_valid, CASE WHEN onset_s >= 1200 THEN onset_s END AS last FROM o WHERE k = 1
  UNION ALL SELECT o.rec, o.idx, o.onset_s, o.k, o.onset_s >= 1200 AND (v.last IS NULL OR NOT (o.onset_s - v.last > 0 AND o.onset_s - v.last <= 1800)),
  CASE WHEN o.onset_s >= 1200 AND (v.last IS NULL OR NOT (o.onset_s - v.last > 0 AND o.onset_s - v.last <= 1800)) THEN o.onset_s ELSE v.last END
  FROM v JOIN o ON o.rec = v.rec AND o.k = v.k + 1)"""
_COUNTS = "c AS (SELECT rec, count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS excluded, round(count(*) FILTER (NOT is_valid) * 100.0 / count(*), 6) AS excluded_pct FROM v GROUP BY rec)"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return seizures(spark, d, dense=True)


@query(f"{_VALID} SELECT rec, idx, onset_s, is_valid FROM v")
def valid_seizures(spark: SparkSession, d: str) -> DataFrame:
    return labels.validated(events(spark, d)).select("rec", "idx", "onset_s", "is_valid")


@query(f"{_VALID}, {_COUNTS} SELECT * FROM c")
def valid_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.valid_counts(labels.validated(events(spark, d)))


@query(f"{_VALID}, {_COUNTS}, t AS (SELECT rec FROM c ORDER BY valid DESC, rec LIMIT 5) SELECT rec, idx, onset_s FROM seizures WHERE rec IN (SELECT rec FROM t)")
def top_n_patients(spark: SparkSession, d: str) -> DataFrame:
    z = events(spark, d)
    top = labels.top_patients(labels.valid_counts(labels.validated(z)), 5)
    return z.join(F.broadcast(top.select("rec")), "rec", "left_semi").select("rec", "idx", "onset_s")


@query(f"""WITH {EVENTS_SQL} SELECT rec, idx, onset_s, eventType, round(onset_s / 60, 6) AS onset_minutes FROM seizures WHERE eventType = 'sz_foc_ia_nm' AND onset_s >= 3000
QUALIFY row_number() OVER (PARTITION BY rec ORDER BY onset_s, idx) = 1""")
def first_seizure(spark: SparkSession, d: str) -> DataFrame:
    return labels.first_event(events(spark, d), "sz_foc_ia_nm", 3000).select("rec", "idx", "onset_s", "eventType", "onset_minutes")


@query(f"""WITH {EVENTS_SQL}, f AS (SELECT *, eventType = 'sz_foc_ia_nm' AS is_sz FROM seizures) SELECT rec, idx, eventType, is_sz FROM f QUALIFY is_sz OR count(*) FILTER (is_sz) OVER (PARTITION BY rec) = 0""")
def fallback_events(spark: SparkSession, d: str) -> DataFrame:
    return labels.with_fallback(events(spark, d).withColumn("is_sz", is_seizure("eventType"))).select("rec", "idx", "eventType", "is_sz")


@query(f"{_BZ} SELECT rec, count(*) AS n FROM clean b WHERE t_ms <= 1500000 AND NOT EXISTS (SELECT 1 FROM seizures s WHERE s.rec = b.rec AND onset_s BETWEEN 0 AND 1500) GROUP BY rec")
def segment_anti(spark: SparkSession, d: str) -> DataFrame:
    hit = seizures(spark, d).where(F.col("onset_s").between(0, 1500)).select("rec")
    b = beats(spark, d).where(tachogram.physiologic() & (F.col("t_ms") <= 1500000))
    return b.join(hit, "rec", "left_anti").groupBy("rec").agg(F.count("*").alias("n"))


#: Every sample, at 4 a second, up to the end of each recording.
_SPANS = """len AS (SELECT rec, max(t_ms) * 4 // 1000 AS n FROM beats GROUP BY rec),
spans AS (SELECT rec, CAST(least(greatest((onset_s - 300 - 60) * 4, 0), n) AS BIGINT) AS st, CAST(least(greatest((onset_s - 300 + 60) * 4, 0), n) AS BIGINT) AS en, 1 AS label, idx FROM seizures JOIN len USING (rec) WHERE onset_s >= 360
  UNION ALL SELECT rec, CAST(least(onset_s * 4, n) AS BIGINT), CAST(least((onset_s + dur_s) * 4, n) AS BIGINT), 2, idx FROM seizures JOIN len USING (rec)),
points AS (SELECT rec, CAST(unnest(range(0, n)) AS BIGINT) AS sample FROM len),
labelled AS (SELECT p.rec, p.sample, coalesce(arg_max(label, idx * 10 + label), 0) AS label FROM points p LEFT JOIN (SELECT * FROM spans WHERE st < en) s ON s.rec = p.rec AND s.st <= p.sample AND p.sample < s.en GROUP BY p.rec, p.sample)"""


#: Samples a second, and of a cell in which spans meet.
_FS, _CELL = 4, 4 * labels.CELL_S


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return beats(spark, d).groupBy("rec").agg(F.expr("max(t_ms) * 4 div 1000").alias("n"))


def _label_spans(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_spans(_dense(spark, d).join(_lengths(spark, d), "rec"), F.col("n"), _FS, 300, 120)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return labels.runs(_label_spans(spark, d), _lengths(spark, d), _CELL)


@query(f"{_B}, {_DENSE}, {_SPANS} SELECT rec, sample, CAST(label AS INTEGER) AS label FROM labelled")
def sph_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.samples_of(_runs(spark, d))


@query(f"""{_B}, {_DENSE}, {_SPANS}, l AS (SELECT unnest([0, 1, 2]) AS label) SELECT CAST(l.label AS INTEGER) AS label, count(x.label) AS n,
  round(count(x.label) * 100.0 / greatest((SELECT count(*) FROM labelled), 1), 6) AS pct, round(count(x.label) / 4, 6) AS seconds FROM l LEFT JOIN labelled x ON x.label = l.label GROUP BY l.label""")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_stats(_runs(spark, d), _FS)


@query(f"""{_B}, {_DENSE}, {_SPANS} SELECT s.rec, s.idx, s.onset_s >= 360 AS target_possible,
  coalesce(bool_or(x.label = 1 AND x.sample >= (s.onset_s - 360) * 4 AND x.sample < (s.onset_s - 240) * 4), false) AS has_target,
  coalesce(bool_or(x.label = 2 AND x.sample >= s.onset_s * 4 AND x.sample < (s.onset_s + s.dur_s) * 4), false) AS has_ictal
  FROM seizures s LEFT JOIN labelled x ON x.rec = s.rec GROUP BY s.rec, s.idx, s.onset_s""")
def label_validation(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_check(_dense(spark, d), _label_spans(spark, d), _FS, 300, 120)


@query(f"""{_B}, {_DENSE}, {_SPANS}, w AS (SELECT rec, CAST(unnest(range(0, (n - 240) // 120 + 1)) AS INTEGER) AS k FROM len WHERE n >= 240),
c AS (SELECT rec, k, CAST(k * 120 + 120 AS BIGINT) AS centre FROM w)
SELECT c.rec, k, centre, CAST(coalesce(arg_max(label, idx * 10 + label), 0) AS INTEGER) AS label FROM c LEFT JOIN (SELECT * FROM spans WHERE st < en) s ON s.rec = c.rec AND s.st <= centre AND centre < s.en GROUP BY c.rec, k, centre""")
def window_centre_labels(spark: SparkSession, d: str) -> DataFrame:
    length = _lengths(spark, d).withColumnRenamed("n", "n_samples")
    return labels.window_centre_labels(length, _label_spans(spark, d), 240, 120, _CELL).select("rec", "k", "centre", "label")


# -- windows ---------------------------------------------------------------------------

_HOP = """o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY minute) - 1 AS r, count(*) OVER (PARTITION BY rec) AS n FROM status),
h AS (SELECT o.*, CAST(unnest(range(CAST(greatest(ceil((r - 59) / 30), 0) AS BIGINT), CAST(least(r // 30, (n - 60) // 30) AS BIGINT) + 1)) AS INTEGER) AS k FROM o WHERE n >= 60),
hop AS (SELECT rec, minute, bin_1, bin_2, bin_3, bin_4, is_ictal, is_postictal, training_mask, k, CAST(r - k * 30 AS INTEGER) AS minute_in_window,
  min(minute) OVER (PARTITION BY rec, k) * 60.0::DOUBLE AS window_start_time, max(minute) OVER (PARTITION BY rec, k) * 60.0::DOUBLE + 60 AS window_end_time, false AS is_padded FROM h)"""
_WCOLS = ["rec", "minute", "bin_1", "bin_2", "bin_3", "bin_4", "is_ictal", "is_postictal", "training_mask", "k", "minute_in_window", "window_start_time", "window_end_time", "is_padded"]


def _hop(spark: SparkSession, d: str) -> DataFrame:
    return windows.hopping(_status(spark, d)).select(*_WCOLS)


@query(f"{_BZ}, {_STATUS}, {_HOP} SELECT * FROM hop")
def windows_60_30(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d)


@query(f"""{_BZ}, {_STATUS}, s AS (SELECT * FROM status WHERE minute < 45), o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY minute) - 1 AS r, count(*) OVER (PARTITION BY rec) AS n, max(greatest(bin_1, bin_2)) OVER (PARTITION BY rec) AS near FROM s),
j AS (SELECT DISTINCT rec, n, CAST(unnest(range(0, 60)) AS INTEGER) AS j FROM (SELECT DISTINCT rec, n FROM o WHERE near > 0 AND n < 60))
SELECT o.rec, minute, bin_1, bin_2, bin_3, bin_4, is_ictal, is_postictal, training_mask, 0 AS k, j.j AS minute_in_window, min(minute) OVER (PARTITION BY o.rec) * 60.0::DOUBLE AS window_start_time,
  max(minute) OVER (PARTITION BY o.rec) * 60.0::DOUBLE + 60 AS window_end_time, j.j >= o.n AS is_padded FROM j JOIN o ON o.rec = j.rec AND o.r = least(j.j, o.n - 1)""")
def short_pad(spark: SparkSession, d: str) -> DataFrame:
    return windows.padded(_status(spark, d).where("minute < 45")).select(*_WCOLS)


_SUMMARY = """sm AS (SELECT rec, count(*) AS n_minutes, count(DISTINCT (window_start_time, window_end_time)) AS n_windows, CAST(sum(CAST(is_padded AS INT)) AS BIGINT) AS n_padded_minutes, CAST(sum(is_ictal) AS BIGINT) AS n_ictal_minutes,
  CAST(sum(is_postictal) AS BIGINT) AS n_postictal_minutes, CAST(sum(training_mask) AS BIGINT) AS n_training_minutes, CAST(sum(bin_1) AS BIGINT) AS n_bin_1, CAST(sum(bin_2) AS BIGINT) AS n_bin_2, CAST(sum(bin_3) AS BIGINT) AS n_bin_3, CAST(sum(bin_4) AS BIGINT) AS n_bin_4 FROM hop GROUP BY rec)"""


@query(f"{_BZ}, {_STATUS}, {_HOP}, {_SUMMARY} SELECT * FROM sm")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return windows.run_summary(_hop(spark, d))


@query(f"""{_BZ}, {_STATUS}, {_HOP}, {_SUMMARY}, t AS (SELECT count(*) AS n_runs, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("n_minutes", "n_windows", "n_ictal_minutes", "n_postictal_minutes", "n_training_minutes", "n_bin_1", "n_bin_2", "n_bin_3", "n_bin_4"))} FROM sm)
SELECT *, {", ".join(f"round(n_bin_{i} * 100.0 / n_minutes, 6) AS pct_bin_{i}" for i in range(1, 5))} FROM t""")
def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    return windows.dataset_totals(windows.run_summary(_hop(spark, d)))


@query(f"""{_BZ}, {_TIME_3}, {_STATUS}, {_HOP}, f AS (SELECT h.*, t.RRMean_3 FROM hop h LEFT JOIN time3 t USING (rec, minute))
SELECT rec, window_start_time, count(*) AS n_rows, CAST(sum(CASE WHEN training_mask = 1 AND RRMean_3 IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_final, round(sum(coalesce(RRMean_3, 0)), 2) AS x_sum FROM f GROUP BY rec, window_start_time HAVING count(*) = 60""")
def seq_window(spark: SparkSession, d: str) -> DataFrame:
    rows = _hop(spark, d).join(features.time_domain(beats(spark, d)).select("rec", "minute", "RRMean_3"), ["rec", "minute"], "left")
    rows = rows.withColumn("RRMean_3", F.col("RRMean_3"))
    s = windows.sequences(rows, ["RRMean_3"])
    x = F.aggregate(F.flatten("x"), F.lit(0.0), lambda a, v: a + F.round(v.cast("double"), 4))
    return s.select("rec", "window_start_time", F.size("x").cast("bigint").alias("n_rows"), F.size(F.filter("final_mask", lambda m: m)).cast("bigint").alias("n_final"), F.round(x, 2).alias("x_sum"))


@query(f"""{_BZ}, {_STATUS}, {_HOP} SELECT rec, k, window_start_time, count(*) AS n FROM (SELECT * FROM hop) GROUP BY ALL""")
def sliding_sequences(spark: SparkSession, d: str) -> DataFrame:
    return windows.hopping(_status(spark, d), 60, 30).groupBy("rec", "k", "window_start_time").agg(F.count("*").alias("n"))


@query(f"""{_BZ}, f AS (SELECT rec, min(onset_s) AS onset FROM seizures WHERE onset_s >= 3000 GROUP BY rec), t AS (SELECT rec, min(t_ms) / 1000.0 AS t0 FROM beats GROUP BY rec)
SELECT rec, k AS minute_offset, CAST(onset - 60 * k AS BIGINT) AS centre_s FROM (SELECT rec, onset, t0, CAST(unnest(range(0, 25)) AS INTEGER) AS k FROM f JOIN t USING (rec)) WHERE onset - 60 * k - 1500 >= t0""")
def pre_seizure_centres(spark: SparkSession, d: str) -> DataFrame:
    first = seizures(spark, d).where("onset_s >= 3000").groupBy("rec").agg(F.min("onset_s").alias("onset"))
    t0 = beats(spark, d).groupBy("rec").agg((F.min("t_ms") / 1000.0).alias("t0"))
    rows = first.join(t0, "rec").withColumn("minute_offset", F.explode(F.sequence(F.lit(0), F.lit(24))))
    rows = rows.withColumn("centre_s", F.col("onset") - 60 * F.col("minute_offset"))
    return rows.where(F.col("centre_s") - 1500 >= F.col("t0")).select("rec", "minute_offset", "centre_s")


@query(f"""{_BZ}, f AS (SELECT rec, min(onset_s) AS onset FROM seizures WHERE onset_s >= 3000 GROUP BY rec), t AS (SELECT rec, min(t_ms) / 1000.0 AS t0, max(t_ms) / 1000.0 AS t1 FROM beats GROUP BY rec),
s AS (SELECT rec, greatest(t0, 1500) + 1500 AS a, onset - 1500 AS z, t0, t1 FROM f JOIN t USING (rec)), n AS (SELECT *, least(25, CAST(floor((z - a) / 60) AS BIGINT)) AS n FROM s WHERE z - a >= 60)
SELECT rec, CAST(i AS INTEGER) AS window_index, round(a + i * (z - a) / n, 6) AS centre_s FROM (SELECT *, unnest(range(0, n)) AS i FROM n) WHERE a + i * (z - a) / n >= t0 + 1500 AND a + i * (z - a) / n <= t1""")
def control_centres(spark: SparkSession, d: str) -> DataFrame:
    first = seizures(spark, d).where("onset_s >= 3000").groupBy("rec").agg(F.min("onset_s").alias("onset"))
    t = beats(spark, d).groupBy("rec").agg((F.min("t_ms") / 1000.0).alias("t0"), (F.max("t_ms") / 1000.0).alias("t1"))
    rows = first.join(t, "rec").withColumns({"a": F.greatest("t0", F.lit(1500.0)) + 1500, "z": F.col("onset") - 1500.0}).where("z - a >= 60")
    rows = rows.withColumn("n", F.least(F.lit(25), F.floor((F.col("z") - F.col("a")) / 60)).cast("int"))
    rows = rows.withColumn("window_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    c = F.col("a") + F.col("window_index") * (F.col("z") - F.col("a")) / F.col("n")
    return rows.withColumn("c", c).where((F.col("c") >= F.col("t0") + 1500) & (F.col("c") <= F.col("t1"))).select("rec", "window_index", F.round("c", 6).alias("centre_s"))


# -- runs and events -------------------------------------------------------------------


@query("""WITH f AS (SELECT 'sub-' || (o_custkey % 50) AS subject, 'ses-' || (o_orderkey % 3) AS session, CASE o_orderstatus WHEN 'F' THEN 'eeg' WHEN 'O' THEN 'ecg' ELSE 'events' END AS modality,
  '/data/sub-' || (o_custkey % 50) || '_task-x' || CASE WHEN o_custkey % 11 = 0 THEN '' ELSE '_run-0' || (o_custkey % 7) END || '_' || o_orderkey AS path FROM orders), r AS (SELECT *, regexp_extract(path, '_run-([^_]*)', 1) AS run FROM f WHERE contains(path, '_run-'))
SELECT subject, session, run, max(path) FILTER (modality = 'eeg') AS eeg_file, max(path) FILTER (modality = 'ecg') AS ecg_file, max(path) FILTER (modality = 'events') AS annotation_file FROM r GROUP BY 1, 2, 3""")
def run_match(spark: SparkSession, d: str) -> DataFrame:
    return matched(_found(spark, d))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of a tree; one in eleven customers has files without a run."""
    text = lambda x: x.cast("string")
    subject = F.concat(F.lit("sub-"), text(F.col("o_custkey") % 50))
    run = F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("_run-0"), text(F.col("o_custkey") % 7)))
    return table(spark, d, "orders").select(
        subject.alias("subject"), F.concat(F.lit("ses-"), text(F.col("o_orderkey") % 3)).alias("session"),
        F.when(F.col("o_orderstatus") == "F", "eeg").when(F.col("o_orderstatus") == "O", "ecg").otherwise("events").alias("modality"),
        F.concat(F.lit("/data/"), subject, F.lit("_task-x"), run, F.lit("_"), text(F.col("o_orderkey"))).alias("path"),
    )


@query("""WITH f AS (SELECT o_orderkey, 'sub-' || (o_custkey % 50) || '_task_run-0' || (o_custkey % 7) || '_x' AS p FROM orders)
SELECT o_orderkey, regexp_extract(p, 'sub-([^_/]*)', 1) AS subject_id, regexp_extract(p, '_run-([^_]*)', 1) AS run FROM f""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("sub-"), (F.col("o_custkey") % 50).cast("string"), F.lit("_task_run-0"), (F.col("o_custkey") % 7).cast("string"), F.lit("_x"))
    return table(spark, d, "orders").select("o_orderkey", subject_id(p).alias("subject_id"), run_number(p).alias("run"))


_KIND = "CASE event_type WHEN 'error' THEN ' SZ_foc ' WHEN 'click' THEN 'bckg' WHEN 'view' THEN '3.6' ELSE event_type END"


@query(f"""WITH e AS (SELECT {_KIND} AS kind FROM events) SELECT kind, coalesce(regexp_matches(lower(trim(kind)), 'seizure|sz|focal|generalized|tonic|clonic|myoclonic|absence|atonic|spasm|automatism') OR lower(trim(kind)) = '3.6', false) AS is_sz, count(*) AS n FROM e GROUP BY 1, 2""")
def seizure_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", " SZ_foc ").when(F.col("event_type") == "click", "bckg").when(F.col("event_type") == "view", "3.6").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(kind.alias("kind")).groupBy("kind", is_seizure("kind").alias("is_sz")).agg(F.count("*").alias("n"))


#: Each event as some code: those of the table, others beyond it, spaces around, and none at all.
_CODE = "CASE WHEN event_id % 13 = 0 THEN NULL ELSE repeat(' ', CAST(event_id % 3 AS INT)) || CAST(event_id // 10 % 9 AS VARCHAR) || '.' || CAST(event_id % 10 AS VARCHAR) || repeat(' ', CAST(event_id % 2 AS INT)) END"
#: Codes and names as they are published: fixed values.
_CODES = """
  ('1.1', 'Focal Aware Motor - Automatisms'),
  ('1.2', 'Focal Aware Motor - Atonic'),
  ('1.3', 'Focal Aware Motor - Clonic'),
  ('1.4', 'Focal Aware Motor - Epileptic spasms'),
  ('1.5', 'Focal Aware Motor - Hyperkinetic'),
  ('1.6', 'Focal Aware Motor - Myoclonic'),
  ('1.7', 'Focal Aware Motor - Tonic'),
  ('2.1', 'Focal Aware Non-motor - Autonomic'),
  ('2.2', 'Focal Aware Non-motor - Behavioral arrest'),
  ('2.3', 'Focal Aware Non-motor - Cognitive'),
  ('2.4', 'Focal Aware Non-motor - Emotional'),
  ('2.5', 'Focal Aware Non-motor - Sensory'),
  ('3.1', 'Focal Impaired Awareness Motor - Automatisms'),
  ('3.2', 'Focal Impaired Awareness Motor - Atonic'),
  ('3.3', 'Focal Impaired Awareness Motor - Clonic'),
  ('3.4', 'Focal Impaired Awareness Motor - Epileptic spasms'),
  ('3.5', 'Focal Impaired Awareness Motor - Hyperkinetic'),
  ('3.6', 'Focal Impaired Awareness Motor - Myoclonic'),
  ('3.7', 'Focal Impaired Awareness Motor - Tonic'),
  ('4.1', 'Focal Impaired Awareness Non-motor - Behavioral arrest'),
  ('4.2', 'Focal Impaired Awareness Non-motor - Cognitive'),
  ('4.3', 'Focal Impaired Awareness Non-motor - Emotional'),
  ('4.4', 'Focal Impaired Awareness Non-motor - Sensory'),
  ('5.1', 'Focal to bilateral tonic-clonic - Aware at onset'),
  ('5.2', 'Focal to bilateral tonic-clonic - Impaired awareness at onset'),
  ('5.3', 'Focal to bilateral tonic-clonic - Awareness unknown at onset'),
  ('6.1', 'Generalized Motor - Tonic-clonic'),
  ('6.2', 'Generalized Motor - Clonic'),
  ('6.3', 'Generalized Motor - Tonic'),
  ('6.4', 'Generalized Motor - Myoclonic'),
  ('6.5', 'Generalized Motor - Myoclonic-tonic-clonic'),
  ('6.6', 'Generalized Motor - Myoclonic-atonic'),
  ('6.7', 'Generalized Motor - Atonic'),
  ('6.8', 'Generalized Motor - Epileptic spasms'),
  ('7.1', 'Generalized Non-motor (absence) - Typical'),
  ('7.2', 'Generalized Non-motor (absence) - Atypical'),
  ('7.3', 'Generalized Non-motor (absence) - Myoclonic'),
  ('7.4', 'Generalized Non-motor (absence) - Eyelid myoclonia')
"""


@query(f"""WITH e AS (SELECT event_id, trim({_CODE}) AS code FROM events), names(code, name) AS (VALUES {_CODES})
SELECT e.code, n.name, n.name IS NOT NULL AS is_sz, count(*) AS n FROM e LEFT JOIN names n USING (code) GROUP BY ALL""")
def seizure_codes(spark: SparkSession, d: str) -> DataFrame:
    text = lambda x: x.cast("string")
    code = F.concat(F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")), text(F.expr("event_id div 10 % 9")), F.lit("."), text(F.col("event_id") % 10), F.repeat(F.lit(" "), (F.col("event_id") % 2).cast("int")))
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 13 != 0, code).alias("kind"))
    rows = labels.named(e, "kind").select(F.trim("kind").alias("code"), "name", is_seizure("kind").alias("is_sz"))
    return rows.groupBy("code", "name", "is_sz").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type")
def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events) AS subjects, CAST((SELECT sum(k) FROM (SELECT count(DISTINCT event_type) AS k FROM events GROUP BY user_id)) AS BIGINT) AS sessions,
  (SELECT count(DISTINCT (user_id, event_type, event_id % 3)) FROM events) AS runs""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 3).alias("run")).distinct()
    per = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("k"), F.count("*").alias("r"))
    return per.agg(F.count("*").alias("subjects"), F.sum("k").alias("sessions"), F.sum("r").alias("runs"))


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS users, round(avg(n), 6) AS mean_n, median(n) AS median_n, min(n) AS min_n, max(n) AS max_n, round(stddev_samp(n), 6) AS sd_n FROM c""")
def events_per_subject(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("users"), F.round(F.avg("n"), 6).alias("mean_n"), F.expr("percentile(n, 0.5)").alias("median_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.round(F.stddev_samp("n"), 6).alias("sd_n"))


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n FROM c QUALIFY rank() OVER (ORDER BY n DESC) <= 10")
def top_k_with_ties(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    # The tenth largest count comes from a top-k of ten rows; what ties with it is kept.
    last = c.select("n").orderBy(F.desc("n")).limit(10).agg(F.min("n").alias("last"))
    return c.join(F.broadcast(last), F.col("n") >= F.col("last")).select("user_id", "n")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def limit_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(20)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY (o_orderkey * 7919) % 1009, o_orderkey LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey").orderBy((F.col("o_orderkey") * 7919) % 1009, "o_orderkey").limit(50)

"""Queries of the statistical, training-set and spectral operators, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.columns import agreement, class_of, log_ratio, ratio
from pulseloom.functions.sql import register
from pulseloom.operators import cleaning, comparison, dataset, features, labels, resample, signal, spectral, stats
from pulseloom.plans import report
from pulseloom.plans.recordings import _B, _BZ, _POIN, _STATUS, _TIME_3, _status, r6
from pulseloom.schemas import FEATURES
from pulseloom.sources.files import decode_weights, encode_weights
from pulseloom.sources.fixtures import beats, seizures, table
from pulseloom.sources.store import staged

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- statistics: line items by return flag as two groups, their numbers as features ------

_LONG = """long AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS grp, f AS feature,
  CASE f WHEN 'price' THEN CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END WHEN 'ties' THEN CAST(o_custkey % 7 AS DOUBLE) WHEN 'flat' THEN 1.0 WHEN 'none' THEN NULL ELSE CAST(o_orderkey % 1000 AS DOUBLE) END AS value
  FROM orders, (SELECT unnest(['price', 'ties', 'flat', 'none', 'key']) AS f) WHERE o_orderstatus IN ('F', 'O'))"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    value = {
        "price": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")), "ties": (F.col("o_custkey") % 7).cast("double"), "flat": F.lit(1.0),
        "none": F.lit(None).cast("double"), "key": (F.col("o_orderkey") % 1000).cast("double"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in value.items()])).alias("v")
    return o.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("grp"), pairs).select("sample_id", "grp", "v.*")


_PREP = f"""{_LONG}, m AS (SELECT *, avg(value) OVER (PARTITION BY feature) AS mean FROM long), i AS (SELECT sample_id, grp, feature, coalesce(value, mean) AS value FROM m WHERE mean IS NOT NULL),
s AS (SELECT *, avg(value) OVER (PARTITION BY feature) AS mu, var_pop(value) OVER (PARTITION BY feature) AS var FROM i), prep AS (SELECT sample_id, grp, feature, (value - mu) / sqrt(var) AS value FROM s WHERE var > 1e-9)"""


@query(f"WITH {_PREP} SELECT sample_id, grp, feature, round(value, 6) AS value FROM prep")
def feature_prep(spark: SparkSession, d: str) -> DataFrame:
    return stats.prepared(_long(spark, d)).select("sample_id", "grp", "feature", *r6("value"))


@query(f"""WITH {_PREP} SELECT feature, round(avg(value) FILTER (grp = 'a'), 6) AS mean_a, round(avg(value) FILTER (grp = 'b'), 6) AS mean_b,
  round((avg(value) FILTER (grp = 'a') - avg(value) FILTER (grp = 'b')) / sqrt((var_pop(value) FILTER (grp = 'a') + var_pop(value) FILTER (grp = 'b')) / 2), 6) AS effect_size FROM prep GROUP BY feature""")
def effect_size(spark: SparkSession, d: str) -> DataFrame:
    return stats.effect_size(stats.prepared(_long(spark, d)), "a", "b").select("feature", *r6("mean_a", "mean_b", "effect_size"))


@query(f"""WITH {_LONG}, k AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM long WHERE value IS NOT NULL)
SELECT feature, count(*) FILTER (grp = 'a') AS n1, count(*) FILTER (grp = 'b') AS n2, round(sum(r) FILTER (grp = 'a') - count(*) FILTER (grp = 'a') * (count(*) FILTER (grp = 'a') + 1) / 2, 4) AS u FROM k GROUP BY feature""")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(_long(spark, d), "a", "b").select("feature", "n1", "n2", F.round("u", 4).alias("u"))


@query(f"""WITH {_PREP}, c AS (SELECT feature, grp, count(*) AS n, avg(value) AS mu FROM prep GROUP BY feature, grp), w AS (SELECT sum((p.value - c.mu) ** 2) AS ssw FROM prep p JOIN c USING (feature, grp)),
t AS (SELECT sum((value - mu) ** 2) AS sst FROM (SELECT value, avg(value) OVER (PARTITION BY feature) AS mu FROM prep)), n AS (SELECT count(DISTINCT sample_id) AS n FROM prep)
SELECT round((sst - ssw) / (ssw / (n - 2)), 6) AS pseudo_f FROM w, t, n""")
def permanova_f(spark: SparkSession, d: str) -> DataFrame:
    return stats.pseudo_f(stats.prepared(_long(spark, d))).select(*r6("pseudo_f"))


#: What a round of a permutation adds: plain arithmetic, so that SQL has the same.
_ROUND = "((({r} + 1) * 48271 + (perm + 1) * 69621 * {k} + ({r} % 1009) * (perm + {k}) * 16807) % 2147483647)"


def _round_hash(half, perm, turn):
    return ((half + 1) * 48271 + (perm + 1) * 69621 * turn + (half % 1009) * (perm + turn) * 16807) % 2147483647


def _rounds_sql() -> str:
    """One pass through the six rounds, as nested selects over (sample_id, perm, v, a, b, n, na)."""
    out = "SELECT *, v % a AS l0, v // a AS r0 FROM fw WHERE t = 0 OR v >= n"
    for k in range(1, 7):
        out = f"SELECT *, r{k - 1} AS l{k}, (l{k - 1} + {_ROUND.format(r=f'r{k - 1}', k=k)}) % {'a' if k % 2 else 'b'} AS r{k} FROM ({out})"
    return out


@query(f"""WITH RECURSIVE {_PREP}, g AS (SELECT DISTINCT sample_id, grp FROM prep), c0 AS (SELECT count(*) FILTER (grp = 'a') AS na, count(*) AS n FROM g), n AS (SELECT na, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM c0), pm AS (SELECT unnest(range(0, 999)) AS perm),
fw AS (SELECT sample_id, perm, row_number() OVER (PARTITION BY perm ORDER BY sample_id % 4096, sample_id) - 1 AS v, 0 AS t, a, b, n, na FROM g, pm, n UNION ALL SELECT sample_id, perm, a * r6 + l6, t + 1, a, b, n, na FROM ({_rounds_sql()})),
d AS (SELECT sample_id, perm, v < na AS in_a FROM fw WHERE t > 0 AND v < n),
c AS (SELECT perm, in_a, feature, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM d JOIN prep USING (sample_id) GROUP BY ALL),
w AS (SELECT perm, sum(q - s * s / n) AS ssw FROM c GROUP BY perm), t AS (SELECT sum(q - s * s / n) AS sst FROM (SELECT feature, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM prep GROUP BY feature)),
o AS (SELECT sum(q - s * s / n) AS ssw FROM (SELECT feature, grp, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM prep GROUP BY feature, grp)),
f AS (SELECT (sst - w.ssw) / (w.ssw / (n.n - 2)) AS f, (sst - o.ssw) / (o.ssw / (n.n - 2)) AS seen FROM w, t, o, n)
SELECT round(any_value(seen), 6) AS pseudo_f, (count(*) FILTER (f >= seen) + 1) / (count(*) + 1) AS p, count(*) AS permutations FROM f""")
def permanova(spark: SparkSession, d: str) -> DataFrame:
    """With the 999 permutations of the reference."""
    return stats.permanova(stats.prepared(_long(spark, d)), hashed=_round_hash, cell=F.col("sample_id") % 4096).select(*r6("pseudo_f"), "p", "permutations")


_SCORES = "s AS (SELECT doc_id, quality = 1 AS truth, (n_chars % 1000) / 1000 AS score, n_chars % 1000 >= 300 AS predicted FROM labels JOIN documents USING (doc_id))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars") % 1000
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", (F.col("quality") == 1).alias("truth"), (n / 1000).alias("score"), (n >= 300).alias("predicted"))


@query(f"WITH {_SCORES} SELECT truth, predicted, count(*) AS n FROM s GROUP BY ALL")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(_scores(spark, d))


@query(f"""WITH {_SCORES}, c AS (SELECT count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (NOT truth AND NOT predicted) AS tn FROM s)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity FROM c""")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.binary_metrics(_scores(spark, d))


_CLASSES = "k AS (SELECT CAST(c_custkey % 4 AS INTEGER) AS truth, CAST(CASE WHEN c_acctbal < 1000 THEN c_nationkey % 4 ELSE c_custkey % 4 END AS INTEGER) AS predicted, CAST(c_custkey % 5 > 0 AS INT) AS m FROM customer)"


def _classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return table(spark, d, "customer").select(k.cast("int").alias("truth"), F.when(F.col("c_acctbal") < 1000, F.col("c_nationkey") % 4).otherwise(k).cast("int").alias("predicted"), (F.col("c_custkey") % 5 > 0).cast("int").alias("m"))


@query(f"""WITH {_CLASSES}, s AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS cls), c AS (SELECT cls, count(*) FILTER (truth = cls) AS support, count(*) FILTER (predicted = cls) AS predicted, count(*) FILTER (truth = cls AND k.predicted = cls) AS tp FROM s, k GROUP BY cls)
SELECT cls, support, predicted, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
  round(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END, 6) AS f1, round(CASE WHEN support > 0 THEN max(support) OVER () / support END, 6) AS imbalance FROM c""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.class_report(_classes(spark, d))


@query(f"WITH {_CLASSES} SELECT round(sum(CASE WHEN truth = predicted THEN m ELSE 0 END) / sum(m), 6) AS accuracy, CAST(sum(m) AS BIGINT) AS n FROM k")
def masked_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return stats.masked_accuracy(_classes(spark, d))


@query(f"""WITH {_SCORES}, k AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s), c AS (SELECT sum(r) FILTER (truth) AS r1, count(*) FILTER (truth) AS n1, count(*) FILTER (NOT truth) AS n0 FROM k)
SELECT round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM c""")
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_scores(spark, d))


@query(f"""WITH {_SCORES}, p AS (SELECT 0.05 + 0.9 * CASE WHEN truth THEN score ELSE 1 - score END AS p_true, CASE WHEN truth THEN 0.6 ELSE 2.0 END AS w, CAST(doc_id % 4 > 0 AS INT) AS m FROM s)
SELECT round(sum(-ln(p_true) * w * m) / greatest(sum(m), 1), 6) AS loss FROM p""")
def masked_ce(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    p = 0.05 + 0.9 * F.when(F.col("truth"), F.col("score")).otherwise(1 - F.col("score"))
    return stats.masked_cross_entropy(s.select(p.alias("p_true"), F.when(F.col("truth"), 0.6).otherwise(2.0).alias("w"), (F.col("doc_id") % 4 > 0).cast("int").alias("m")))


# -- training sets ---------------------------------------------------------------------

_CLS = f"{_STATUS}, cls AS (SELECT rec, minute, CASE WHEN bin_2 = 1 THEN 1 WHEN bin_3 = 1 THEN 2 WHEN bin_4 = 1 THEN 3 ELSE 0 END AS cls, training_mask = 1 AS trainable FROM status)"


def _cls(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("rec", "minute", class_of(["bin_1", "bin_2", "bin_3", "bin_4"]).alias("cls"), (F.col("training_mask") == 1).alias("trainable"))


@query(f"{_BZ}, {_CLS} SELECT rec, minute, cls, trainable FROM cls")
def onehot_class(spark: SparkSession, d: str) -> DataFrame:
    return _cls(spark, d)


_WEIGHTS = """n AS (SELECT rec, cls, count(*) AS n_c, sum(count(*)) OVER (PARTITION BY rec) AS n, count(*) OVER (PARTITION BY rec) AS k FROM cls WHERE trainable GROUP BY rec, cls),
e AS (SELECT rec, c FROM (SELECT DISTINCT rec FROM cls WHERE trainable), (SELECT unnest([0, 1, 2, 3]) AS c)),
cw AS (SELECT CAST(c AS INTEGER) AS cls, round(avg(coalesce(CASE WHEN k > 1 THEN n / (k * n_c) ELSE 1 END, 1)), 6) AS weight FROM e LEFT JOIN n ON n.rec = e.rec AND n.cls = e.c GROUP BY c)"""


@query(f"{_BZ}, {_CLS}, {_WEIGHTS} SELECT cls, weight FROM cw")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return dataset.class_weights(_cls(spark, d))


@query(f"{_BZ}, {_CLS}, {_WEIGHTS} SELECT cls, weight FROM cw")
def class_weights_json(spark: SparkSession, d: str) -> DataFrame:
    return decode_weights(encode_weights(dataset.class_weights(_cls(spark, d))))


_SPLIT = """su AS (SELECT DISTINCT user_id AS subject FROM events), o AS (SELECT subject, row_number() OVER (ORDER BY (subject * 7919) % 1009, subject) AS k, count(*) OVER () AS n FROM su),
b AS (SELECT *, greatest(1, CAST(floor(n * 0.2) AS BIGINT)) AS nt FROM o), c AS (SELECT *, {val} AS nv FROM b), sp AS (SELECT subject, CASE WHEN k <= {test} THEN 'test' WHEN k <= {test} + nv THEN 'val' ELSE 'train' END AS split FROM c)"""
_SPLIT3 = _SPLIT.format(test="nt", val="greatest(1, CAST(floor((n - nt) * 0.2) AS BIGINT))")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("subject"))


@query(f"WITH {_SPLIT3} SELECT subject, split FROM sp")
def split_3way(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(_subjects(spark, d), (F.col("subject") * 7919) % 1009)


@query(f"WITH {_SPLIT.format(test='0', val='greatest(1, CAST(floor(n * 0.2) AS BIGINT))')} SELECT subject, split FROM sp")
def split_2way(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(_subjects(spark, d), (F.col("subject") * 7919) % 1009, test=0)


@query("SELECT event_id, user_id AS subject, event_type AS recording, CASE WHEN user_id IN (1, 3, 8) THEN 'val' ELSE 'train' END AS split FROM events")
def split_by_subjects(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_by(_event_rows(spark, d), subjects=[1, 3, 8])


@query("SELECT event_id, user_id AS subject, event_type AS recording, CASE WHEN event_type IN ('error') THEN 'val' ELSE 'train' END AS split FROM events")
def split_by_recordings(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_by(_event_rows(spark, d), recordings=["error"])


@query("SELECT event_id, user_id AS subject, event_type AS recording, CASE WHEN (event_id * 48271 % 2147483647) / 2147483647 < 0.2 THEN 'val' ELSE 'train' END AS split FROM events")
def split_random_rows(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split_rows(_event_rows(spark, d), F.col("event_id") * 48271 % 2147483647 / 2147483647)


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("recording"))


@query(f"WITH {_SPLIT3} SELECT split, CAST(length(event_type) % 4 AS INTEGER) AS cls, count(*) AS n FROM events JOIN sp ON subject = user_id GROUP BY 1, 2")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("subject"), (F.length("event_type") % 4).alias("cls"))
    return dataset.class_distribution(e.join(split_3way(spark, d), "subject"))


_TRAIN = "tr AS (SELECT value, CAST(event_id % 97 AS DOUBLE) AS k, 5.0 AS flat FROM events JOIN sp ON subject = user_id WHERE split = 'train')"


def _train_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("subject"), "value", (F.col("event_id") % 97).cast("double").alias("k"), F.lit(5.0).alias("flat"))
    rows = e.join(split_3way(spark, d), "subject")
    return rows, rows.where("split = 'train'")


@query(f"""WITH {_SPLIT3}, {_TRAIN} SELECT f AS feature, round(CASE f WHEN 'value' THEN avg(value) WHEN 'k' THEN avg(k) ELSE avg(flat) END, 6) AS mean,
  round(CASE f WHEN 'value' THEN stddev_pop(value) WHEN 'k' THEN stddev_pop(k) ELSE 1 END, 6) AS std FROM tr, (SELECT unnest(['value', 'k', 'flat']) AS f) GROUP BY f""")
def scaler_fit(spark: SparkSession, d: str) -> DataFrame:
    return dataset.scaler(_train_rows(spark, d)[1], ["value", "k", "flat"]).select("feature", *r6("mean", "std"))


@query(f"""WITH {_SPLIT3}, {_TRAIN}, s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM tr)
SELECT event_id, user_id AS subject, split, round((value - mv) / sv, 6) AS value, round((event_id % 97 - mk) / sk, 6) AS k, 0.0::DOUBLE AS flat FROM events JOIN sp ON subject = user_id, s""")
def scaler_apply(spark: SparkSession, d: str) -> DataFrame:
    rows, train = _train_rows(spark, d)
    names = ["value", "k", "flat"]
    return dataset.scaled(rows, dataset.scaler(train, names), names).select("event_id", "subject", "split", *r6(*names))


# -- set operations --------------------------------------------------------------------


@query("SELECT c_custkey AS k FROM customer WHERE c_nationkey < 12 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("k"))
    return a.union(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("SELECT c_custkey AS k, 'a' AS tag FROM customer UNION ALL SELECT s_suppkey, 'b' FROM supplier")
def tagged_concat(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("a").alias("tag"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("b").alias("tag")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set_minus(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


# -- scalar rules ----------------------------------------------------------------------


@query("""WITH x AS (SELECT s_suppkey, s_acctbal AS a, CAST(s_nationkey - 5 AS DOUBLE) AS b FROM supplier)
SELECT s_suppkey, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 6) AS guarded, round(CASE WHEN a > 0 AND b > 0 THEN ln(a / b) ELSE 0 END, 6) AS log0, round(CASE WHEN a > 0 AND b > 0 THEN ln(a / b) END, 6) AS lognull,
  CASE WHEN abs(b) < 3 THEN 'GOOD' WHEN abs(b) < 10 THEN 'MODERATE' ELSE 'POOR' END AS bucket FROM x""")
def guarded_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_nationkey") - 5).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select(
        "s_suppkey", F.round(ratio(a, F.when(b > 0, b)), 6).alias("guarded"), F.round(log_ratio(a, b), 6).alias("log0"), F.round(log_ratio(a, b, None), 6).alias("lognull"),
        agreement(F.abs(b), 3, 10).alias("bucket"),
    )


# -- spectra as aggregations -----------------------------------------------------------

#: Clean beats of each trailing window, numbered from 1; minutes as in the grid.
_WIN = "w{m} AS (SELECT g.rec, g.minute, CAST(row_number() OVER (PARTITION BY g.rec, g.minute ORDER BY beat_idx) AS INTEGER) AS i, rr_ms, t_ms, CAST(count(*) OVER (PARTITION BY g.rec, g.minute) AS INTEGER) AS n FROM grid g JOIN clean c ON c.rec = g.rec AND c.t_ms BETWEEN (g.minute - {m}) * 60000 AND g.minute * 60000 WHERE g.minute >= {m})"


_DFT = _WIN.format(m=10) + """, l AS (SELECT rec, minute, n, list(rr_ms / 1000.0 ORDER BY i) AS x FROM w10 WHERE n >= 20 GROUP BY ALL),
e AS (SELECT n, k, list(cos(2 * pi() * ((k * j) % n) / n) ORDER BY j) AS c, list(sin(2 * pi() * ((k * j) % n) / n) ORDER BY j) AS s FROM (SELECT n, k, unnest(range(0, n)) AS j FROM (SELECT n, CAST(unnest(range(0, n // 2 + 1)) AS INTEGER) AS k FROM (SELECT DISTINCT n FROM l))) GROUP BY n, k),
dft AS (SELECT rec, minute, n, k, list_dot_product(x, c) ** 2 + list_dot_product(x, s) ** 2 AS p FROM l JOIN e USING (n))"""


def _dft(spark: SparkSession, d: str) -> DataFrame:
    """Every 10-minute window of every recording."""
    return signal.spectra(beats(spark, d), "dft")


@query(f"{_B}, {_DFT} SELECT rec, minute, k, round(p, 4) AS p FROM dft")
def dft_power(spark: SparkSession, d: str) -> DataFrame:
    return _dft(spark, d).select("rec", "minute", "k", F.round("p", 4).alias("p"))


@query(f"""{_B}, {_DFT}, b AS (SELECT rec, minute, k / n AS f, p FROM dft), t AS (SELECT rec, minute, (p + lag(p) OVER w) / 2 * (f - lag(f) OVER w) AS a FROM b WHERE f BETWEEN 0.04 AND 0.15 WINDOW w AS (PARTITION BY rec, minute ORDER BY f))
SELECT rec, minute, round(greatest(coalesce(sum(a), 0), 0), 6) AS lf FROM t GROUP BY rec, minute""")
def dft_band_power(spark: SparkSession, d: str) -> DataFrame:
    return spectral.band_power(_dft(spark, d).select("rec", "minute", "f", "p"), ["rec", "minute"], 0.04, 0.15, "lf").select("rec", "minute", *r6("lf"))


@query(f"""{_B}, {_DFT}, m AS (SELECT rec, minute, k AS f, p, lag(p) OVER w AS b, lead(p) OVER w AS a, max(p) OVER (PARTITION BY rec, minute) AS m FROM dft WHERE k > 0 WINDOW w AS (PARTITION BY rec, minute ORDER BY k)) SELECT rec, minute, f, round(p, 4) AS p FROM m WHERE p > b AND p > a AND p >= 0.1 * m""")
def spectral_local_max(spark: SparkSession, d: str) -> DataFrame:
    s = _dft(spark, d).where("k > 0").select("rec", "minute", F.col("k").alias("f"), "p")
    return spectral.local_maxima(s, ["rec", "minute"]).select("rec", "minute", "f", F.round("p", 4).alias("p"))


_SAMPEN = _WIN.format(m=3) + """, t3 AS (SELECT rec, minute, i, n, rr_ms AS x0, lead(rr_ms) OVER o AS x1, lead(rr_ms, 2) OVER o AS x2, var_pop(rr_ms / 1000.0) OVER (PARTITION BY rec, minute) AS v FROM w3 WINDOW o AS (PARTITION BY rec, minute ORDER BY i))"""


@query(f"""{_B}, {_SAMPEN}, k AS (SELECT a.rec, a.minute, count(*) AS B, count(*) FILTER (abs(a.x2 - b.x2) <= 200 * sqrt(a.v)) AS A FROM t3 a JOIN t3 b ON a.rec = b.rec AND a.minute = b.minute AND a.i < b.i AND a.i <= a.n - 2 AND b.i <= b.n - 2 WHERE abs(a.x0 - b.x0) <= 200 * sqrt(a.v) AND abs(a.x1 - b.x1) <= 200 * sqrt(a.v) GROUP BY 1, 2)
SELECT w.rec, w.minute, any_value(w.n) AS n, coalesce(any_value(k.A), 0) AS A, coalesce(any_value(k.B), 0) AS B, CASE WHEN coalesce(any_value(k.A), 0) > 0 THEN round(-ln(any_value(k.A) / any_value(k.B)), 6) ELSE 0 END AS samp_en FROM w3 w LEFT JOIN k USING (rec, minute) WHERE w.n >= 10 GROUP BY w.rec, w.minute""")
def samp_en_v2(spark: SparkSession, d: str) -> DataFrame:
    """Version 2 over every 3-minute window, by blocks of an hour."""
    return features.sample_entropy(signal.sample_entropy_counts(beats(spark, d), 3, 10), ["rec", "minute"])


@query(f"""{_B}, {_WIN.format(m=5)}, t5 AS (SELECT rec, minute, i, n, rr_ms AS x0, lead(rr_ms) OVER o AS x1, lead(rr_ms, 2) OVER o AS x2, 200 * stddev_pop(rr_ms / 1000.0) OVER (PARTITION BY rec, minute) AS tol FROM w5 WHERE n >= 10 WINDOW o AS (PARTITION BY rec, minute ORDER BY i)),
c5 AS (SELECT a.rec, a.minute, a.i, any_value(a.n) AS n, any_value(a.tol) AS tol, count(*) AS c2, count(*) FILTER (b.i <= b.n - 2 AND abs(a.x2 - b.x2) <= a.tol) AS c3 FROM t5 a JOIN t5 b ON a.rec = b.rec AND a.minute = b.minute
  WHERE a.i <= a.n - 1 AND b.i <= b.n - 1 AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol GROUP BY a.rec, a.minute, a.i)
SELECT rec, minute, round(CASE WHEN any_value(tol) > 0 THEN sum(ln(c2 / (n - 1))) / any_value(n - 2) - sum(ln(c3 / (n - 2))) FILTER (i <= n - 2) / any_value(n - 4) ELSE 0 END, 6) AS ap_en FROM c5 GROUP BY rec, minute""")
def apen_v2_5(spark: SparkSession, d: str) -> DataFrame:
    """Version 2 over every 5-minute window, by blocks of an hour."""
    return signal.approximate_entropies(beats(spark, d), 5, 10).select("rec", "minute", *r6("ap_en"))


#: 100 frequencies up to 0.5 over the first 25 minutes, where the comparison of spectra looks.
_FREQ = [round(0.005 * i, 3) for i in range(1, 101)]
_LS = f"""y AS (SELECT rec, t_ms / 1000.0 AS t, rr_ms / 1000.0 - avg(rr_ms / 1000.0) OVER (PARTITION BY rec) AS y FROM clean WHERE t_ms <= 1500000), g AS (SELECT rec, t, y, f, 2 * pi() * f AS w FROM y, (SELECT unnest({_FREQ})::DOUBLE AS f)),
u AS (SELECT rec, f, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / (2 * max(w)) AS tau FROM g GROUP BY rec, f),
ls AS (SELECT rec, f, 0.5 * (sum(y * cos(w * (t - tau))) ** 2 / sum(cos(w * (t - tau)) ** 2) + sum(y * sin(w * (t - tau))) ** 2 / sum(sin(w * (t - tau)) ** 2)) AS p FROM g JOIN u USING (rec, f) GROUP BY rec, f)"""


def _first_25(spark: SparkSession, d: str) -> DataFrame:
    """The clean beats of the segment that the comparison of spectra is defined on: seconds 0 to 1500."""
    return beats(spark, d).where("t_ms <= 1500000 and rr_ms between 200 and 2000")


def _ls(spark: SparkSession, d: str) -> DataFrame:
    x = _first_25(spark, d).select("rec", (F.col("t_ms") / 1000.0).alias("t"), (F.col("rr_ms") / 1000.0).alias("x"))
    return spectral.lomb_scargle(x, ["rec"], _FREQ)


@query(f"""{_B}, {_LS} SELECT rec, f, round(p, 6) AS p FROM ls""")
def lomb_scargle(spark: SparkSession, d: str) -> DataFrame:
    return _ls(spark, d).select("rec", "f", *r6("p"))


@query(f"""{_B}, {_LS}, v AS (SELECT rec, var_pop(y) AS variance FROM y GROUP BY rec) SELECT rec, f, round(p * variance / (sum(p) OVER (PARTITION BY rec) * 0.005), 6) AS p FROM ls JOIN v USING (rec)""")
def lomb_density(spark: SparkSession, d: str) -> DataFrame:
    v = _first_25(spark, d).groupBy("rec").agg(F.var_pop(F.col("rr_ms") / 1000.0).alias("variance"))
    return spectral.scaled_to_variance(_ls(spark, d), v, ["rec"], 0.005).select("rec", "f", *r6("p"))


@query(f"""{_B}, y AS (SELECT rec, beat_idx AS i, CAST(rr_ms AS DOUBLE) AS x FROM clean), z AS (SELECT rec, beat_idx AS i, CAST(rr_ms AS DOUBLE) AS x FROM beats),
d AS (SELECT 'a' AS tag, rec, i, x, x - lag(x) OVER (PARTITION BY rec ORDER BY i) AS d FROM y UNION ALL SELECT 'b', rec, i, x, x - lag(x) OVER (PARTITION BY rec ORDER BY i) FROM z),
e AS (SELECT *, d - lag(d) OVER (PARTITION BY tag, rec ORDER BY i) AS d2, CAST(d * lag(d) OVER (PARTITION BY tag, rec ORDER BY i) < 0 AS INT) AS turn FROM d),
g AS (SELECT tag, rec, avg(x) AS m, stddev_pop(x) AS s, max(x) AS hi, min(x) AS lo, avg(abs(d2)) AS rough, sum(turn) / count(*) AS turns FROM e GROUP BY tag, rec)
SELECT a.rec, round(a.m / b.m, 6) AS mean_kept, round(a.s / b.s, 6) AS sd_kept, greatest(a.hi - b.hi, b.lo - a.lo, 0) AS overshoot, round(a.rough, 6) AS roughness, round(a.turns, 6) AS sign_changes, round((a.hi - a.lo) / (b.hi - b.lo), 6) AS range_ratio
FROM g a JOIN g b ON a.rec = b.rec AND a.tag = 'a' AND b.tag = 'b'""")
def interpolation_quality(spark: SparkSession, d: str) -> DataFrame:
    b = beats(spark, d).select("rec", F.col("beat_idx").alias("i"), F.col("rr_ms").cast("double").alias("x"))
    q = spectral.quality(b.where(F.col("x").between(200, 2000)), b)
    return q.select("rec", *r6("mean_kept", "sd_kept"), "overshoot", *r6("roughness", "sign_changes", "range_ratio"))


# -- kernels ---------------------------------------------------------------------------

_ENTROPY = f"""{_SAMPEN}, p3 AS (SELECT a.rec, a.minute, any_value(a.n) AS n, count(*) AS B, count(*) FILTER (b.i <= b.n - 2 AND abs(a.x2 - b.x2) <= 200 * a.v) AS A FROM t3 a JOIN t3 b ON a.rec = b.rec AND a.minute = b.minute
  WHERE a.i <> b.i AND a.i <= a.n - 2 AND b.i <= b.n - 1 AND abs(a.x0 - b.x0) <= 200 * a.v AND abs(a.x1 - b.x1) <= 200 * a.v GROUP BY a.rec, a.minute),
se AS (SELECT w.rec, w.minute, any_value(CASE WHEN w.n >= 10 AND A > 0 AND w.v > 0 THEN -ln(A / B * w.n / (w.n - 2)) ELSE 0 END) AS SampEn_3 FROM t3 w LEFT JOIN p3 USING (rec, minute) GROUP BY w.rec, w.minute),
{_WIN.format(m=5)}, t5 AS (SELECT rec, minute, i, n, rr_ms AS x0, lead(rr_ms) OVER o AS x1, lead(rr_ms, 2) OVER o AS x2, var_pop(rr_ms / 1000.0) OVER (PARTITION BY rec, minute) AS v FROM w5 WHERE n >= 10 WINDOW o AS (PARTITION BY rec, minute ORDER BY i)),
c5 AS (SELECT a.rec, a.minute, a.i, any_value(a.n) AS n, count(*) AS c2, count(*) FILTER (b.i <= b.n - 2 AND abs(a.x2 - b.x2) <= 200 * a.v) AS c3 FROM t5 a JOIN t5 b ON a.rec = b.rec AND a.minute = b.minute
  WHERE a.i <= a.n - 1 AND b.i <= b.n - 1 AND abs(a.x0 - b.x0) <= 200 * a.v AND abs(a.x1 - b.x1) <= 200 * a.v GROUP BY a.rec, a.minute, a.i),
ae AS (SELECT rec, minute, avg(ln(c2 / (n - 1))) - avg(ln(c3 / (n - 2))) FILTER (i <= n - 2) AS ApEn_5 FROM c5 GROUP BY rec, minute)"""


@query(f"{_B}, {_ENTROPY} SELECT rec, minute, round(SampEn_3, 6) AS SampEn_3, round(ApEn_5, 6) AS ApEn_5 FROM se FULL JOIN ae USING (rec, minute)")
def entropy_3_5(spark: SparkSession, d: str) -> DataFrame:
    names = ("SampEn_3", "ApEn_5")
    rows = signal.minute_features(beats(spark, d), only=names).select("rec", "minute", *r6(*names))
    return rows.where("SampEn_3 IS NOT NULL OR ApEn_5 IS NOT NULL")


#: The not-a-knot spline by elimination, first down, then up the knots; values every quarter second; Hann-windowed segments of 256, half overlapped, against cosines and sines.
_POWERS = f"""{_WIN.format(m=10)}, kn AS (SELECT rec, minute, i, n, t_ms / 1000.0::DOUBLE AS t, rr_ms / 1000.0::DOUBLE AS y FROM w10 WHERE n >= 20),
hm AS (SELECT *, lead(t) OVER o - t AS h, (lead(y) OVER o - y) / (lead(t) OVER o - t) AS m FROM kn WINDOW o AS (PARTITION BY rec, minute ORDER BY i)),
nb AS (SELECT *, lag(h) OVER o AS hp, lag(h, 2) OVER o AS hpp, lag(m) OVER o AS mp, lag(m, 2) OVER o AS mpp, lead(h) OVER o AS hn, lead(m) OVER o AS mn FROM hm WINDOW o AS (PARTITION BY rec, minute ORDER BY i)),
sy AS (SELECT rec, minute, i, n, CASE WHEN i = 1 THEN 0 WHEN i = n THEN hp + hpp ELSE h END AS lo, CASE WHEN i = 1 THEN hn WHEN i = n THEN hpp ELSE 2 * (hp + h) END AS mi, CASE WHEN i = 1 THEN h + hn WHEN i = n THEN 0 ELSE hp END AS up,
  CASE WHEN i = 1 THEN ((h + 2 * (h + hn)) * hn * m + h * h * mn) / (h + hn) WHEN i = n THEN (hp * hp * mpp + (2 * (hp + hpp) + hp) * hpp * mp) / (hp + hpp) ELSE 3 * (h * mp + hp * m) END AS rh FROM nb),
fw AS (SELECT rec, minute, i, n, up, mi, rh FROM sy WHERE i = 1 UNION ALL SELECT s.rec, s.minute, s.i, s.n, s.up, s.mi - s.lo / f.mi * f.up, s.rh - s.lo / f.mi * f.rh FROM fw f JOIN sy s ON s.rec = f.rec AND s.minute = f.minute AND s.i = f.i + 1),
bw AS (SELECT rec, minute, i, rh / mi AS d FROM fw WHERE i = n UNION ALL SELECT f.rec, f.minute, f.i, (f.rh - f.up * b.d) / f.mi FROM bw b JOIN fw f ON f.rec = b.rec AND f.minute = b.minute AND f.i = b.i - 1),
sp AS (SELECT k.rec, k.minute, k.i, k.t, k.y, b.d, lead(k.t) OVER o - k.t AS h, lead(k.y) OVER o AS y1, lead(b.d) OVER o AS d1 FROM kn k JOIN bw b USING (rec, minute, i) WINDOW o AS (PARTITION BY k.rec, k.minute ORDER BY k.i)),
en AS (SELECT rec, minute, min(t) AS t0, CAST(ceil((max(t) - min(t)) * 4 - 1e-9) AS BIGINT) AS m FROM kn GROUP BY rec, minute), ev AS (SELECT rec, minute, j, t0 + j / 4 AS at FROM (SELECT rec, minute, t0, unnest(range(0, m)) AS j FROM en)),
ip AS (SELECT e.rec, e.minute, e.j, (e.at - s.t) / s.h AS u, s.* EXCLUDE (rec, minute) FROM ev e ASOF JOIN (SELECT * FROM sp WHERE h IS NOT NULL) s ON e.rec = s.rec AND e.minute = s.minute AND e.at >= s.t),
xs AS (SELECT rec, minute, list((1 + 2 * u) * (1 - u) ** 2 * y + u * (1 - u) ** 2 * h * d + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * h * d1 ORDER BY j) AS x, count(*) AS m FROM ip GROUP BY rec, minute),
sg AS (SELECT rec, minute, list_slice(x, s * 128 + 1, s * 128 + 256) AS x FROM (SELECT *, unnest(range(0, (m - 256) // 128 + 1)) AS s FROM xs)), ce AS (SELECT rec, minute, list_transform(x, lambda v: v - list_avg(x)) AS x FROM sg),
ba AS (SELECT k, list((0.5 - 0.5 * cos(2 * pi() * j / 256)) * cos(2 * pi() * ((k * j) % 256) / 256) ORDER BY j) AS c, list((0.5 - 0.5 * cos(2 * pi() * j / 256)) * sin(2 * pi() * ((k * j) % 256) / 256) ORDER BY j) AS s FROM (SELECT unnest(range(0, 129)) AS k), (SELECT unnest(range(0, 256)) AS j) GROUP BY k),
ps AS (SELECT rec, minute, k / 64 AS f, avg(list_dot_product(x, c) ** 2 + list_dot_product(x, s) ** 2) / (4 * 96.0) * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END AS p FROM ce, ba GROUP BY rec, minute, k),
ar AS (SELECT rec, minute, f, lag(f) OVER o AS f0, (p + lag(p) OVER o) / 2 * (f - lag(f) OVER o) AS a FROM ps WINDOW o AS (PARTITION BY rec, minute ORDER BY f)),
bd AS (SELECT rec, minute, sum(a) AS total, coalesce(sum(a) FILTER (f0 >= 0.003 AND f <= 0.04), 0) AS vlf, coalesce(sum(a) FILTER (f0 >= 0.04 AND f <= 0.15), 0) AS lf, coalesce(sum(a) FILTER (f0 >= 0.15 AND f <= 0.4), 0) AS hf FROM ar GROUP BY rec, minute),
fr AS (SELECT rec, minute, round(total * 1e6, 2) AS TOTAL_POWER, round(vlf * 1e6, 2) AS VLF_POWER, round(lf * 1e6, 2) AS LF_POWER, round(hf * 1e6, 2) AS HF_POWER, round(100 * vlf / total, 4) AS VLF_NORM, round(100 * lf / total, 4) AS LF_NORM, round(100 * hf / total, 4) AS HF_NORM, round(lf / hf, 6) AS LF_TO_HF FROM bd)"""
_DIGITS = {n: 2 if "POWER" in n else 6 if "TO" in n else 4 for n in signal.FREQUENCY}


@query(f"{_B.replace('WITH', 'WITH RECURSIVE')}, {_POWERS} SELECT * FROM fr")
def frequency_10(spark: SparkSession, d: str) -> DataFrame:
    rows = signal.minute_features(beats(spark, d), only=[f"{n}_10" for n in _DIGITS]).where("TOTAL_POWER_10 IS NOT NULL")
    return rows.select("rec", "minute", *[F.round(f"{n}_10", k).alias(n) for n, k in _DIGITS.items()])


def _bundle_sql() -> str:
    plain = {"time3": ["RRMean_3", "RRMin_3", "RRMax_3", "RRVar_3", "RMSSD_3", "SDNN_3", "SDSD_3", "NN50_3", "pNN50_3"], "poin": ["SD1_5", "SD2_5", "SD1toSD2_5"], "se": ["SampEn_3"], "ae": ["ApEn_5"]}
    source = {c: f"{t}.{c}" for t, cs in plain.items() for c in cs} | {f"{c}_10": f"fr.{c}" for c in _DIGITS}
    has = " + ".join(f"CAST({source[c]} IS NOT NULL AS INT)" for c in FEATURES)
    value = ", ".join(f"CAST(coalesce(round({source[c]}, 6), 0) AS DOUBLE) AS {c}" for c in FEATURES)
    return f"""{_BZ.replace('WITH', 'WITH RECURSIVE')}, {_TIME_3}, {_POIN}, {_ENTROPY}, {_POWERS}, {_STATUS}
SELECT g.rec, g.minute, {value}, CAST({has} = 22 AS INT) AS mask, round(({has}) / 22, 6) AS mask_ratio, st.* EXCLUDE (rec, minute)
FROM grid g JOIN status st USING (rec, minute) LEFT JOIN time3 USING (rec, minute) LEFT JOIN poin USING (rec, minute) LEFT JOIN se ON se.rec = g.rec AND se.minute = g.minute AND time3.n IS NOT NULL LEFT JOIN ae ON ae.rec = g.rec AND ae.minute = g.minute LEFT JOIN fr ON fr.rec = g.rec AND fr.minute = g.minute"""


@query(_bundle_sql())
def hrv_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All 22 features of each minute, their mask, and the status of the minute."""
    # Features, grid and status all look at the beats.
    b = staged(beats(spark, d), "bundle-beats")
    digits = {f"{n}_10": k for n, k in _DIGITS.items()}
    f = signal.minute_features(b).select("rec", "minute", *[F.round(c, digits.get(c, 6)).alias(c) for c in FEATURES])
    rows = features.grid(b).join(f, ["rec", "minute"], "left")
    return features.availability(rows, FEATURES).join(labels.status(features.grid(b), seizures(spark, d)), ["rec", "minute"])


# -- cleaning --------------------------------------------------------------------------

#: Islands between pairs of long intervals, each merged by a scan with what lies behind and ahead as two lists.
_MERGED = """sh AS (SELECT *, rr_ms <= 250 AS s, coalesce(lag(rr_ms <= 250) OVER o, false) AS b FROM beats WINDOW o AS (PARTITION BY rec ORDER BY beat_idx)),
isl AS (SELECT *, sum(CAST(NOT s AND NOT b AS INT)) OVER (PARTITION BY rec ORDER BY beat_idx ROWS UNBOUNDED PRECEDING) AS island FROM sh),
run AS (SELECT rec, min(beat_idx) AS first, list(rr_ms ORDER BY beat_idx) AS l, list(t_ms ORDER BY beat_idx) AS t FROM isl GROUP BY rec, island),
mg AS (SELECT rec, first, len(l) AS n, CAST([] AS BIGINT[]) AS lft, l AS rgt, CAST([] AS BIGINT[]) AS lt, t AS rt FROM run UNION ALL
  SELECT rec, first, n, CASE c WHEN 0 THEN list_append(lft, rgt[1]) WHEN 1 THEN lft ELSE lft[1:len(lft) - 1] END,
    CASE c WHEN 0 THEN rgt[2:] WHEN 1 THEN list_prepend(rgt[1] + rgt[2], rgt[3:]) ELSE list_prepend(lft[len(lft)] + rgt[1], rgt[2:]) END,
    CASE c WHEN 0 THEN list_append(lt, rt[1]) WHEN 1 THEN lt ELSE lt[1:len(lt) - 1] END, CASE c WHEN 2 THEN list_prepend(lt[len(lt)], rt[2:]) ELSE rt[2:] END
  FROM (SELECT *, CASE WHEN rgt[1] > 250 OR (len(lft) = 0 AND len(rgt) = 1) THEN 0 WHEN len(rgt) > 1 AND (len(lft) = 0 OR rgt[2] < lft[len(lft)]) THEN 1 ELSE 2 END AS c FROM mg WHERE len(rgt) > 0)),
mo AS (SELECT rec, first, lt[1] AS t_ms, n - len(lft) AS lost, unnest(lft) AS rr_ms, unnest(range(0, len(lft))) AS j FROM mg WHERE len(rgt) = 0),
merged AS (SELECT rec, row_number() OVER o - 1 AS i, rr_ms, CASE WHEN max(lost) OVER (PARTITION BY rec) > 0 THEN CAST(first(t_ms) OVER o + coalesce(sum(rr_ms) OVER (PARTITION BY rec ORDER BY first, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) ELSE t_ms END AS t_ms
  FROM mo WINDOW o AS (PARTITION BY rec ORDER BY first, j))"""


@query(f"{_B.replace('WITH', 'WITH RECURSIVE')}, {_MERGED} SELECT rec, i, rr_ms / 1000 AS rr_s, t_ms / 1000 AS t_s FROM merged")
def merge_short(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.merged_short(beats(spark, d)).select("rec", "i", (F.col("rr_ms") / 1000).alias("rr_s"), (F.col("t_ms") / 1000).alias("t_s"))


#: Slow trends of ce (rec, i, x, t) removed: onto an even grid, through two high-pass sections sample by sample, forward and backward over the oddly extended grid, and back to the beats. No recording here is too brief for that.
_HIGHPASS = """fa AS (SELECT rec, count(*) AS n, min(t) AS t0, max(t) - min(t) AS span FROM ce GROUP BY rec), fb AS (SELECT *, greatest(4.0::DOUBLE, n * 2 / span) AS fs FROM fa),
fc AS (SELECT *, CAST(floor(span * fs) AS BIGINT) AS m, tan(pi() * 0.003 / fs) AS w FROM fb), fd AS (SELECT *, span / (m - 1) AS step, 1 / (1 + 2 * cos(pi() / 8) * w + w * w) AS u1, 1 / (1 + 2 * cos(3 * pi() / 8) * w + w * w) AS u2 FROM fc),
co AS (SELECT *, 2 * (w * w - 1) * u1 AS a1, (1 - 2 * cos(pi() / 8) * w + w * w) * u1 AS a2, 2 * (w * w - 1) * u2 AS d1, (1 - 2 * cos(3 * pi() / 8) * w + w * w) * u2 AS d2 FROM fd),
li AS (SELECT c.*, t0, step, m, i = n - 2 AS final, lead(x) OVER o AS x1, lead(t) OVER o AS t1 FROM ce c JOIN co USING (rec) WINDOW o AS (PARTITION BY rec ORDER BY i)),
gr AS (SELECT rec, m, k, x + (t0 + k * step - t) * (x1 - x) / (t1 - t) AS g FROM (SELECT *, unnest(range(CAST(ceil((t - t0) / step) AS BIGINT), CASE WHEN final THEN m ELSE least(CAST(ceil((t1 - t0) / step) AS BIGINT), m) END)) AS k FROM li WHERE t1 > t)),
ex AS (SELECT rec, k, g, m FROM gr UNION ALL SELECT a.rec, -b.k, 2 * a.g - b.g, a.m FROM gr a JOIN gr b ON a.rec = b.rec AND a.k = 0 AND b.k BETWEEN 1 AND 15
  UNION ALL SELECT a.rec, 2 * (a.m - 1) - b.k, 2 * a.g - b.g, a.m FROM gr a JOIN gr b ON a.rec = b.rec AND a.k = a.m - 1 AND b.k BETWEEN a.m - 16 AND a.m - 2),
f1 AS (SELECT rec, k, NULL::DOUBLE AS y, -u1 * g AS z1, u1 * g AS z2, 0::DOUBLE AS z3, 0::DOUBLE AS z4, u1, a1, a2, u2, d1, d2 FROM ex JOIN co USING (rec) WHERE k = -15
  UNION ALL SELECT rec, k + 1, u2 * y1 + z3, -2 * u1 * g - a1 * y1 + z2, u1 * g - a2 * y1, -2 * u2 * y1 - d1 * (u2 * y1 + z3) + z4, u2 * y1 - d2 * (u2 * y1 + z3), u1, a1, a2, u2, d1, d2
  FROM (SELECT f.*, e.g, u1 * e.g + z1 AS y1 FROM f1 f JOIN ex e ON e.rec = f.rec AND e.k = f.k)),
fo AS (SELECT rec, k - 1 AS k, y AS g FROM f1 WHERE y IS NOT NULL),
b1 AS (SELECT rec, k, NULL::DOUBLE AS y, -u1 * g AS z1, u1 * g AS z2, 0::DOUBLE AS z3, 0::DOUBLE AS z4, u1, a1, a2, u2, d1, d2 FROM fo JOIN co USING (rec) WHERE k = m + 14
  UNION ALL SELECT rec, k - 1, u2 * y1 + z3, -2 * u1 * g - a1 * y1 + z2, u1 * g - a2 * y1, -2 * u2 * y1 - d1 * (u2 * y1 + z3) + z4, u2 * y1 - d2 * (u2 * y1 + z3), u1, a1, a2, u2, d1, d2
  FROM (SELECT f.*, e.g, u1 * e.g + z1 AS y1 FROM b1 f JOIN fo e ON e.rec = f.rec AND e.k = f.k WHERE f.k >= 0)),
yo AS (SELECT rec, k + 1 AS k, y, coalesce(lag(y) OVER (PARTITION BY rec ORDER BY k DESC), y) AS y1 FROM b1 JOIN co USING (rec) WHERE y IS NOT NULL AND k + 1 BETWEEN 0 AND m - 1),
hp AS (SELECT c.rec, c.i, y + ((t - t0) / step - k) * (y1 - y) AS x, t FROM ce c JOIN co USING (rec) JOIN yo ON yo.rec = c.rec AND yo.k = least(CAST(floor((t - t0) / step) AS BIGINT), m - 1))"""
_WINSORISED = """wq AS (SELECT rec, quantile_cont(rr_ms, 0.25) AS q1, quantile_cont(rr_ms, 0.75) AS q3, count(*) AS n FROM {src} GROUP BY rec),
wr AS (SELECT rec, i, t_ms, CASE WHEN rr_ms < q1 - 1.5 * (q3 - q1) THEN q1 WHEN rr_ms > q3 + 1.5 * (q3 - q1) THEN q3 ELSE rr_ms END AS rr FROM {src} JOIN wq USING (rec) WHERE n >= 4)"""


@query(f"""{_B.replace('WITH', 'WITH RECURSIVE')}, {_MERGED}, {_WINSORISED.format(src="merged")},
ce AS (SELECT rec, i, (rr - avg(rr) OVER (PARTITION BY rec)) / 1000 AS x, (first(t_ms) OVER o + coalesce(sum(rr) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 1000 AS t FROM wr WINDOW o AS (PARTITION BY rec ORDER BY i)), {_HIGHPASS}
SELECT rec, i, round(x, 6) AS x, t AS t_s FROM hp""")
def preprocess_chain(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.cleaned(beats(spark, d)).select("rec", "i", *r6("x"), "t_s")


# -- even grids ------------------------------------------------------------------------

_KNOTS = """kd AS (SELECT rec, t_ms AS t, rr_ms AS y, lag(t_ms) OVER (PARTITION BY rec ORDER BY t_ms, beat_idx) AS b FROM beats),
kt AS (SELECT rec, row_number() OVER w - 1 AS i, t, y, first(t) OVER w AS t0, lead(t) OVER w - t AS h, (lead(y) OVER w - y) / (lead(t) OVER w - t) AS m FROM kd WHERE b IS NULL OR b < t WINDOW w AS (PARTITION BY rec ORDER BY t)),
nb AS (SELECT *, lag(m) OVER w AS mb1, lag(m, 2) OVER w AS mb2, lag(h) OVER w AS hb1, lag(h, 2) OVER w AS hb2, lead(m) OVER w AS ma1, lead(h) OVER w AS ha1, count(*) OVER (PARTITION BY rec) AS n FROM kt WINDOW w AS (PARTITION BY rec ORDER BY i))"""
_EDGE = "CASE WHEN (({h0} * 2 + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}) * {m0} <= 0 THEN 0.0 WHEN {m0} * {m1} < 0 AND abs((({h0} * 2 + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1})) > abs({m0}) * 3 THEN {m0} * 3 ELSE (({h0} * 2 + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}) END"
_PCHIP = f"""sd AS (SELECT rec, i, t, y, t0, h, CASE WHEN mb1 IS NULL THEN CASE WHEN ma1 IS NULL THEN m ELSE {_EDGE.format(h0="h", h1="ha1", m0="m", m1="ma1")} END
  WHEN m IS NULL THEN CASE WHEN mb2 IS NULL THEN mb1 ELSE {_EDGE.format(h0="hb1", h1="hb2", m0="mb1", m1="mb2")} END
  WHEN mb1 * m > 0 THEN (h * 2 + hb1 + (h + hb1 * 2)) / ((h * 2 + hb1) / mb1 + (h + hb1 * 2) / m) ELSE 0.0 END AS d FROM nb)"""
_AKIMA = """pq AS (SELECT *, coalesce(mb1, m * 2 - ma1) AS p, coalesce(m, mb1 * 2 - mb2) AS q, CASE WHEN m IS NULL THEN mb1 * 3 - mb2 * 2 ELSE coalesce(ma1, m * 2 - mb1) END AS q2, CASE WHEN mb1 IS NULL THEN m * 3 - ma1 * 2 ELSE coalesce(mb2, mb1 * 2 - m) END AS p2 FROM nb),
ww AS (SELECT *, abs(q2 - q) AS w1, abs(p - p2) AS w2, max(abs(q2 - q) + abs(p - p2)) OVER (PARTITION BY rec) AS top FROM pq),
sd AS (SELECT rec, i, t, y, t0, h, CASE WHEN n = 2 THEN coalesce(m, mb1) WHEN w1 + w2 <= top * 1e-9 THEN (p + q) / 2 ELSE (w1 * p + w2 * q) / (w1 + w2) END AS d FROM ww)"""
#: The not-a-knot system by elimination, first down, then up the knots.
_CUBIC = """sy AS (SELECT rec, i, n, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN hb1 + hb2 ELSE h END AS lo, CASE WHEN i = 0 THEN ha1 WHEN i = n - 1 THEN hb2 ELSE 2 * (hb1 + h) END AS mi, CASE WHEN i = 0 THEN h + ha1 WHEN i = n - 1 THEN 0 ELSE hb1 END AS up,
  CASE WHEN i = 0 THEN ((h + 2 * (h + ha1)) * ha1 * m + h * h * ma1) / (h + ha1) WHEN i = n - 1 THEN (hb1 * hb1 * mb2 + (2 * (hb1 + hb2) + hb1) * hb2 * mb1) / (hb1 + hb2) ELSE 3 * (h * mb1 + hb1 * m) END AS rh FROM nb),
fw AS (SELECT rec, i, n, CAST(up AS DOUBLE) AS up, CAST(mi AS DOUBLE) AS mi, rh FROM sy WHERE i = 0 UNION ALL SELECT s.rec, s.i, s.n, s.up, s.mi - s.lo / f.mi * f.up, s.rh - s.lo / f.mi * f.rh FROM fw f JOIN sy s ON s.rec = f.rec AND s.i = f.i + 1),
bw AS (SELECT rec, i, rh / mi AS d FROM fw WHERE i = n - 1 UNION ALL SELECT f.rec, f.i, (f.rh - f.up * b.d) / f.mi FROM bw b JOIN fw f ON f.rec = b.rec AND f.i = b.i - 1),
sd AS (SELECT rec, i, t, y, t0, h, d FROM nb JOIN bw USING (rec, i))"""
_GRID = "SELECT *, unnest(range(CAST(ceil((t - t0) / 250) AS BIGINT), CAST(ceil((t + h - t0) / 250) AS BIGINT))) AS j FROM {0} WHERE h IS NOT NULL"
_CURVE = f"""sl AS (SELECT *, lead(y) OVER w AS y1, lead(d) OVER w AS d1 FROM sd WINDOW w AS (PARTITION BY rec ORDER BY i)),
ev AS (SELECT *, (t0 + j * 250 - t) / h AS u, t0 + j * 250 AS pos FROM ({_GRID.format("sl")})), ev2 AS (SELECT *, 1.0::DOUBLE - u AS v FROM ev),
curve AS (SELECT rec, j AS i, ((u * 2 + 1) * v * v * y + u * v * v * h * d + u * u * (3.0::DOUBLE - u * 2) * y1 + u * u * (u - 1) * h * d1) / 1000 AS x, pos / 1000 AS t_s FROM ev2)"""


@query(f"{_B.replace('WITH', 'WITH RECURSIVE')}, {_KNOTS}, {_CUBIC}, {_CURVE} SELECT rec, i, round(x, 6) AS x, t_s FROM curve")
def resample_4hz(spark: SparkSession, d: str) -> DataFrame:
    return resample.resampled(beats(spark, d)).select("rec", "i", *r6("x"), "t_s")


@query(f"{_B}, {_KNOTS}, {_PCHIP}, {_CURVE} SELECT * FROM curve")
def resample_pchip(spark: SparkSession, d: str) -> DataFrame:
    return resample.resampled(beats(spark, d), method="pchip")


@query(f"{_B}, {_KNOTS}, {_AKIMA}, {_CURVE} SELECT * FROM curve")
def resample_akima(spark: SparkSession, d: str) -> DataFrame:
    return resample.resampled(beats(spark, d), method="akima")


@query(f"""{_B}, {_KNOTS}, sl AS (SELECT *, lead(y) OVER (PARTITION BY rec ORDER BY i) AS y1 FROM kt)
SELECT rec, j AS i, (y * h + (t0 + j * 250 - t) * (y1 - y)) / (h * 1000) AS x, (t0 + j * 250) / 1000 AS t_s FROM ({_GRID.format("sl")})""")
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    """Values as they are: intervals are multiples of 20 ms, so that many would tie if rounded."""
    return resample.resampled(beats(spark, d), method="linear")


_WELCH = f"""{_B}, l AS (SELECT rec, list(rr_ms / 1000.0::DOUBLE ORDER BY beat_idx) AS x, count(*) AS n FROM beats GROUP BY rec), sg AS (SELECT rec, list_slice(x, s * 128 + 1, s * 128 + 256) AS x FROM (SELECT *, unnest(range(0, (n - 256) // 128 + 1)) AS s FROM l)),
ce AS (SELECT rec, list_transform(x, lambda v: v - list_avg(x)) AS x FROM sg),
ba AS (SELECT k, list((0.5 - 0.5 * cos(2 * pi() * j / 256)) * cos(2 * pi() * ((k * j) % 256) / 256) ORDER BY j) AS c, list((0.5 - 0.5 * cos(2 * pi() * j / 256)) * sin(2 * pi() * ((k * j) % 256) / 256) ORDER BY j) AS s FROM (SELECT unnest(range(0, 129)) AS k), (SELECT unnest(range(0, 256)) AS j) GROUP BY k)
SELECT rec, k / 256 AS f, round(avg(list_dot_product(x, c) ** 2 + list_dot_product(x, s) ** 2) / 96 * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END, 6) AS p FROM ce, ba GROUP BY rec, k"""


@query(_WELCH)
def welch_psd(spark: SparkSession, d: str) -> DataFrame:
    """Over all beats of each recording, in segments of 256."""
    b = beats(spark, d).select("rec", (F.col("beat_idx") - 1).alias("i"), (F.col("rr_ms") / 1000.0).alias("x"))
    return spectral.welch(b, 1.0, 256).select("rec", "f", *r6("p"))


@query(_WELCH)
def welch_series(spark: SparkSession, d: str) -> DataFrame:
    """The same by a table function in SQL text, which goes through each recording's beats in order."""
    register(spark)
    view = f"beats_{uuid.uuid4().hex}"
    beats(spark, d).selectExpr("rec", "beat_idx AS i", "rr_ms / 1000.0D AS x").createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT rec, f, round(p, 6) AS p FROM welch_series(TABLE({view}) PARTITION BY rec ORDER BY (i), 1.0D, 256)")
    finally:
        spark.catalog.dropTempView(view)


# -- periodograms of all windows -------------------------------------------------------

#: Sums over beats and frequencies, turned by half the phase of the double frequency: {t} a beat's time, {f} the k-th of 1000 frequencies.
_PERIODOGRAM = """{win}, lw AS (SELECT rec, minute, n, i, rr_ms / 1000.0::DOUBLE - avg(rr_ms / 1000.0::DOUBLE) OVER (PARTITION BY rec, minute) AS y, {t} AS t FROM w10 WHERE n >= 20),
lk AS (SELECT k, {f} AS f FROM (SELECT unnest(range(0, 1000)) AS k)), lt AS (SELECT rec, minute, f, y, cos(2 * pi() * f * t) AS c, sin(2 * pi() * f * t) AS s FROM lw, lk),
lu AS (SELECT rec, minute, f, sum(y * c) AS yc, sum(y * s) AS ys, sum(c * c) AS cc, sum(s * s) AS ss, sum(c * s) AS cs FROM lt GROUP BY rec, minute, f), lv AS (SELECT *, cos(atan2(2 * cs, cc - ss) / 2) AS u, sin(atan2(2 * cs, cc - ss) / 2) AS v FROM lu),
lq AS (SELECT rec, minute, sum(y * y) AS yy, count(*) AS n FROM lw GROUP BY rec, minute),
lx AS (SELECT *, ss * u * u - 2 * cs * u * v + cc * v * v AS sx FROM lv),
lp AS (SELECT rec, minute, f, 0.5 * ((yc * u + ys * v) ** 2 / (cc * u * u + 2 * cs * u * v + ss * v * v) + CASE WHEN sx > 1e-9 * (cc + ss) THEN (ys * u - yc * v) ** 2 / sx ELSE 0 END) AS p FROM lx)"""


def _spectra(spark: SparkSession, d: str, kind: str, digits: int) -> DataFrame:
    return signal.spectra(beats(spark, d), kind).select("rec", "minute", F.round("f", 9).alias("f"), F.round("p", digits).alias("p"))


@query(f"""{_B}, {_PERIODOGRAM.format(win=_WIN.format(m=10), t="i - 1", f="0.001 + k * (0.499::DOUBLE / 999)")} SELECT rec, minute, round(f, 9) AS f, round(2 * p / yy, 6) AS p FROM lp JOIN lq USING (rec, minute)""")
def lomb_scargle_10(spark: SparkSession, d: str) -> DataFrame:
    """Normalised, over beat numbers, at 1000 frequencies of 0.001 to 0.5."""
    return _spectra(spark, d, "lomb", 6)


@query(f"""{_B}, {_PERIODOGRAM.format(win=_WIN.format(m=10), t="t_ms / 1000.0::DOUBLE", f="0.003 + k * (0.497::DOUBLE / 999)")}
SELECT rec, minute, round(f, 9) AS f, round(p * (yy / n) / (sum(p) OVER (PARTITION BY rec, minute) * (0.497::DOUBLE / 999)), 4) AS p FROM lp JOIN lq USING (rec, minute)""")
def lomb_density_10(spark: SparkSession, d: str) -> DataFrame:
    """Over time, at 1000 frequencies of 0.003 to 0.5, scaled to the variance."""
    return _spectra(spark, d, "density", 4)


# -- Lomb-Scargle against Welch ---------------------------------------------------------

_PSD = f"""{_B.replace('WITH', 'WITH RECURSIVE')}, seg AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY beat_idx) - 1 AS i, rr_ms, t_ms FROM clean WHERE t_ms <= 1500000 QUALIFY count(*) OVER (PARTITION BY rec) >= 20),
{_WINSORISED.format(src="seg")}, ce AS (SELECT rec, i, (rr - avg(rr) OVER (PARTITION BY rec)) / 1000 AS x, t_ms / 1000 AS t FROM wr), {_HIGHPASS},
hy AS (SELECT rec, t, x - avg(x) OVER (PARTITION BY rec) AS y FROM hp), hf AS (SELECT k, 0.003 + k * (0.497::DOUBLE / 999) AS f FROM (SELECT unnest(range(0, 1000)) AS k)),
hs AS (SELECT rec, k, f, sum(y * cos(2 * pi() * f * t)) AS yc, sum(y * sin(2 * pi() * f * t)) AS ys, sum(cos(2 * pi() * f * t) ** 2) AS cc, sum(sin(2 * pi() * f * t) ** 2) AS ss, sum(cos(2 * pi() * f * t) * sin(2 * pi() * f * t)) AS cs FROM hy, hf GROUP BY rec, k, f),
ht AS (SELECT *, cos(atan2(2 * cs, cc - ss) / 2) AS u, sin(atan2(2 * cs, cc - ss) / 2) AS v FROM hs),
hd AS (SELECT rec, k, f, 0.5 * ((yc * u + ys * v) ** 2 / (cc * u * u + 2 * cs * u * v + ss * v * v) + (ys * u - yc * v) ** 2 / (ss * u * u - 2 * cs * u * v + cc * v * v)) AS p FROM ht),
hv AS (SELECT rec, var_pop(y) AS variance FROM hy GROUP BY rec),
sa AS (SELECT rec, 'a' AS m, k, f, p * variance / (sum(p) OVER (PARTITION BY rec) * (0.497::DOUBLE / 999)) AS p FROM hd JOIN hv USING (rec)),
hk AS (SELECT rec, i AS beat_idx, CAST(round(t * 1000) AS BIGINT) AS t_ms, x * 1000 AS rr_ms FROM hp), {_KNOTS.replace("FROM beats", "FROM hk")}, {_AKIMA}, {_CURVE},
wx AS (SELECT rec, list(x ORDER BY i) AS x, count(*) AS m FROM curve GROUP BY rec), wg AS (SELECT rec, list_slice(x, s * 512 + 1, s * 512 + 2048) AS x FROM (SELECT *, unnest(range(0, (m - 2048) // 512 + 1)) AS s FROM wx)),
wb AS (SELECT k, list((0.5 - 0.5 * cos(2 * pi() * j / 2048)) * cos(2 * pi() * ((k * j) % 2048) / 2048) ORDER BY j) AS c, list((0.5 - 0.5 * cos(2 * pi() * j / 2048)) * sin(2 * pi() * ((k * j) % 2048) / 2048) ORDER BY j) AS s FROM (SELECT unnest(range(0, 1025)) AS k), (SELECT unnest(range(0, 2048)) AS j) GROUP BY k),
sb AS (SELECT rec, 'b' AS m, k, k / 512 AS f, avg(list_dot_product(x, c) ** 2 + list_dot_product(x, s) ** 2) / (4 * 768) * CASE WHEN k IN (0, 1024) THEN 1 ELSE 2 END AS p FROM wg, wb GROUP BY rec, k),
sp AS (SELECT * FROM sa UNION ALL SELECT * FROM sb), sq AS (SELECT *, lag(f) OVER o AS f0, (p + lag(p) OVER o) / 2 * (f - lag(f) OVER o) AS area, lag(p) OVER o AS before, lead(p) OVER o AS after, max(p) OVER (PARTITION BY rec, m) AS top FROM sp WINDOW o AS (PARTITION BY rec, m ORDER BY f)),
bp AS (SELECT rec, m, coalesce(sum(area) FILTER (f0 >= 0.003 AND f <= 0.4), 0) AS total, coalesce(sum(area) FILTER (f0 >= 0.04 AND f <= 0.15), 0) AS lf, coalesce(sum(area) FILTER (f0 >= 0.15 AND f <= 0.4), 0) AS hf FROM sq GROUP BY rec, m),
pk AS (SELECT rec, m, 0 AS n, list(k ORDER BY p DESC, k DESC) AS l FROM sq WHERE p > before AND p > after AND p >= 0.1 * top GROUP BY rec, m UNION ALL SELECT rec, m, n + 1, list_filter(l, lambda x: abs(x - l[1]) >= 10) FROM pk WHERE len(l) > 0),
pn AS (SELECT rec, m, max(n) AS n FROM pk GROUP BY rec, m), sn AS (SELECT rec, count(*) AS n FROM seg GROUP BY rec),
pc AS (SELECT a.rec, a.total AS ta, b.total AS tb, a.hf AS ha, b.hf AS hb, CASE WHEN a.hf > 0 THEN a.lf / a.hf ELSE 0 END AS qa, CASE WHEN b.hf > 0 THEN b.lf / b.hf ELSE 0 END AS qb, coalesce(pa.n, 0) AS na, coalesce(pb.n, 0) AS nb, sn.n
  FROM bp a JOIN bp b ON a.rec = b.rec AND a.m = 'a' AND b.m = 'b' JOIN sn ON sn.rec = a.rec LEFT JOIN pn pa ON pa.rec = a.rec AND pa.m = 'a' LEFT JOIN pn pb ON pb.rec = a.rec AND pb.m = 'b'),
cmp AS (SELECT rec, CASE WHEN tb > 0 THEN abs(ta - tb) / tb ELSE 0 END * 100 AS total_diff, CASE WHEN qb > 0 THEN abs(qa - qb) / qb ELSE 0 END * 100 AS lf_hf_diff, CASE WHEN qa > 0 AND qb > 0 THEN abs(ln(qa) - ln(qb)) END AS ln_lf_hf_diff,
  CASE WHEN hb > 0 THEN abs(ha - hb) / hb ELSE 0 END * 100 AS hf_diff, CAST(abs(na - nb) AS INTEGER) AS peak_count_diff, n AS n_rr_intervals, ta AS total_power_ls, tb AS total_power_welch, qa AS lf_hf_ls, qb AS lf_hf_welch FROM pc)"""
_DIFFS = ["total_diff", "lf_hf_diff", "ln_lf_hf_diff", "hf_diff"]
_POWERS_OF = ["total_power_ls", "total_power_welch", "lf_hf_ls", "lf_hf_welch"]


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return comparison.psd_comparison(_first_25(spark, d))


# -- the statistical report --------------------------------------------------------------

_REPORT = f"""{_BZ.replace('WITH', 'WITH RECURSIVE')}, one AS (SELECT rec, min(onset_s) AS onset FROM seizures WHERE onset_s >= 3000 GROUP BY rec), cut AS (SELECT b.rec, beat_idx, rr_ms, t_ms, onset FROM clean b JOIN one USING (rec) WHERE t_ms <= onset * 1000),
ok AS (SELECT rec, max(onset) AS onset FROM cut GROUP BY rec HAVING count(*) >= 100 AND max(t_ms) + 2000 >= max(onset) * 1000), src AS (SELECT rec, beat_idx, rr_ms, t_ms FROM cut WHERE rec IN (SELECT rec FROM ok)), {_MERGED.replace("FROM beats", "FROM src")}, {_WINSORISED.format(src="merged")},
ce AS (SELECT rec, i, (rr - avg(rr) OVER (PARTITION BY rec)) / 1000 AS x, (first(t_ms) OVER o + coalesce(sum(rr) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / 1000 AS t FROM wr WINDOW o AS (PARTITION BY rec ORDER BY i)), {_HIGHPASS},
se AS (SELECT h.*, onset, lag(x) OVER (PARTITION BY rec ORDER BY i) AS xb, lag(t) OVER (PARTITION BY rec ORDER BY i) AS tb FROM hp h JOIN ok USING (rec) QUALIFY count(*) OVER (PARTITION BY rec) >= 50),
fx AS (SELECT rec, min(t) AS t0, max(t) AS t1, max(onset) AS onset, greatest(min(t), 1500) + 1500 AS a, max(onset) - 1500.0::DOUBLE AS z FROM se GROUP BY rec HAVING max(onset) - 1500 - greatest(min(t), 1500) >= 1500),
ct AS (SELECT rec, t0, 'pre' AS grp, CAST(k AS INTEGER) AS k, CAST(onset - 60 * k AS DOUBLE) AS centre FROM (SELECT *, unnest(range(0, 25)) AS k FROM fx)
  UNION ALL SELECT rec, t0, 'control', CAST(k AS INTEGER), CAST(a + k * (z - a) / n AS DOUBLE) FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, least(25, CAST(floor((z - a) / 60) AS BIGINT)) AS n FROM fx)) WHERE a + k * (z - a) / n <= t1),
rw AS (SELECT c.rec, grp, k, centre, t, tb, x * 1000 AS ms, (x - xb) * 1000 AS d, (x + xb) * 1000 AS s FROM ct c JOIN se USING (rec) WHERE centre - 1500 >= t0 AND t BETWEEN centre - 300 AND centre),
ft AS (SELECT rec, grp, k, centre, count(*) FILTER (t >= centre - 180) AS n3, count(*) AS n5, avg(ms) FILTER (t >= centre - 180) AS RRMean_3, min(ms) FILTER (t >= centre - 180) AS RRMin_3, max(ms) FILTER (t >= centre - 180) AS RRMax_3, var_samp(ms) FILTER (t >= centre - 180) AS RRVar_3, stddev_samp(ms) FILTER (t >= centre - 180) AS SDNN_3,
  sqrt(avg(d * d) FILTER (tb >= centre - 180)) AS RMSSD_3, stddev_samp(d) FILTER (tb >= centre - 180) AS SDSD_3, CAST(count(*) FILTER (tb >= centre - 180 AND abs(d) > 50) AS DOUBLE) AS NN50_3, count(*) FILTER (tb >= centre - 180 AND abs(d) > 50) * 100.0 / count(*) FILTER (tb >= centre - 180) AS pNN50_3,
  stddev_samp(d) FILTER (tb >= centre - 300) / sqrt(2) AS SD1_5, stddev_samp(s) FILTER (tb >= centre - 300) / sqrt(2) AS SD2_5, CASE WHEN stddev_samp(s) FILTER (tb >= centre - 300) > 0 THEN stddev_samp(d) FILTER (tb >= centre - 300) / stddev_samp(s) FILTER (tb >= centre - 300) ELSE 0 END AS SD1toSD2_5 FROM rw GROUP BY ALL)"""
_PLAIN = ", ".join(report.PLAIN)


def _onsets(spark: SparkSession, d: str) -> DataFrame:
    return seizures(spark, d).where(F.col("onset_s") >= report.LEAST_ONSET_S).groupBy("rec").agg(F.min("onset_s").alias("onset"))


def _regular(spark: SparkSession, d: str) -> DataFrame:
    return beats(spark, d).where(F.col("rr_ms").between(200, 2000))


@query(f"{_REPORT} SELECT rec, grp, k, round(centre, 6) AS centre, {', '.join(f'round(CASE WHEN n{n[-1]} >= 5 THEN {n} END, 4) AS {n}' for n in report.PLAIN)} FROM ft")
def report_features(spark: SparkSession, d: str) -> DataFrame:
    """Features at the minutes ahead of each first seizure, and of its control period, from cleaned beats."""
    series = staged(report.prepared_series(_regular(spark, d), _onsets(spark, d)), "report-series")
    rows = report.features_at(series, report.centres(series), with_shapes=False)
    return rows.select("rec", "grp", "k", *r6("centre"), *[F.round(n, 4).alias(n) for n in report.PLAIN])


@query()
def seizure_report(spark: SparkSession, d: str) -> DataFrame:
    """All 22 features: means of the groups, effect size, U and p. Without SQL: entropies and spectra of each window; tests hold them to plain windows."""
    rows, _ = report.report(_regular(spark, d), _onsets(spark, d))
    return rows.select("feature", *r6("mean_pre", "mean_control", "effect_size"), "n_pre", "n_control", "u", *r6("p"))


@query(f"{_PSD} SELECT rec, {', '.join(f'round({c}, 6) AS {c}' for c in _DIFFS + _POWERS_OF)}, peak_count_diff, n_rr_intervals FROM cmp")
def psd_comparison(spark: SparkSession, d: str) -> DataFrame:
    """On seconds 0 to 1500, where this comparison is defined."""
    return _compared(spark, d).select("rec", *r6(*_DIFFS, *_POWERS_OF), "peak_count_diff", "n_rr_intervals")


def _bucket(c: str, good: float, moderate: float) -> str:
    return f"CASE WHEN {c} < {good} THEN 'GOOD' WHEN {c} < {moderate} THEN 'MODERATE' ELSE 'POOR' END"


@query(f"{_PSD} SELECT {_bucket('total_diff', 10, 25)} AS total, {_bucket('lf_hf_diff', 15, 30)} AS lf_hf, {_bucket('ln_lf_hf_diff', 0.2, 0.5)} AS ln_lf_hf, count(*) AS n FROM cmp GROUP BY ALL")
def psd_agreement(spark: SparkSession, d: str) -> DataFrame:
    g = lambda c_, a, b: agreement(F.col(c_), a, b)
    rows = _compared(spark, d).select("rec", g("total_diff", 10, 25).alias("total"), g("lf_hf_diff", 15, 30).alias("lf_hf"), g("ln_lf_hf_diff", 0.2, 0.5).alias("ln_lf_hf"))
    return rows.groupBy("total", "lf_hf", "ln_lf_hf").agg(F.count("*").alias("n"))


@query(f"""{_PSD}, g AS (SELECT count(*) AS runs, count(*) FILTER (total_diff < 10) + count(*) FILTER (lf_hf_diff < 15) AS good, stddev_samp(total_diff) AS sd, avg(total_diff) AS a, avg(lf_hf_diff) AS b FROM cmp)
SELECT runs, good, round(good / (runs * 2), 6) AS share_good, CASE WHEN sd < 10 THEN 'HIGH' WHEN sd < 20 THEN 'MODERATE' ELSE 'LOW' END AS consistency, CASE WHEN a < 15 AND b < 20 THEN 'YES' ELSE 'WITH CAUTION' END AS recommended FROM g""")
def psd_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Consistency of the methods over all recordings, and whether they are fit for prediction."""
    return stats.verdict(_compared(spark, d))


@query(f"""{_PSD}, u AS (UNPIVOT (SELECT {', '.join(_DIFFS)} FROM cmp) ON {', '.join(_DIFFS)} INTO NAME difference VALUE v)
SELECT difference, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(min(v), 6) AS least, round(max(v), 6) AS most FROM u GROUP BY difference""")
def psd_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """A row for each difference between the methods: count, mean, deviation, quartiles, extremes."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("difference"), F.col(c).alias("v")) for c in _DIFFS])).alias("x")
    each = _compared(spark, d).select(pairs).select("x.*")
    return stats.summary(each, "v", ["difference"]).select("difference", "n", "mean", "std", "q1", "median", "q3", *r6("least", "most"))


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, min(value) AS least, max(value) AS most FROM events")
def value_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(table(spark, d, "events"), "value")

"""Functions for SQL text: entropies, band powers and spectra, registered with a session.

``register`` gives samp_en, samp_en_v2, ap_en, ap_en_v2 (array -> double), band_power (f, p, low, high -> double),
norm_sf (double -> double), and two table functions: welch_psd(array, fs, segment) -> (f, p), and
welch_series(TABLE(t) PARTITION BY rec ORDER BY (i), fs, segment) -> (rec, k, f, p), which holds one segment
of a series at a time, however long that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions import kernels as K


class WelchSeries:
    """Welch's density of the rows (rec, i, x) of one partition, in their order, by half overlapped segments."""

    def __init__(self) -> None:
        self.rec, self.held, self.total, self.segments, self.fs, self.segment = None, [], 0.0, 0, 1.0, 0

    def _add(self) -> None:
        self.total = self.total + K.welch(np.asarray(self.held, float), self.fs, len(self.held))[1]
        self.segments += 1

    def eval(self, row: Row, fs: float, segment: int) -> None:
        self.rec, self.fs, self.segment = row["rec"], float(fs), int(segment)
        self.held.append(row["x"])
        if len(self.held) == self.segment:
            self._add()
            self.held = self.held[self.segment - self.segment // 2 :]

    def terminate(self) -> Iterator[tuple]:
        if not self.segments and self.held:  # shorter than a segment
            self.segment = len(self.held)
            self._add()
        for k, p in enumerate(self.total / self.segments if self.segments else []):
            yield self.rec, k, k * self.fs / self.segment, float(p)


class WelchArray:
    """(f, p) of an array."""

    def eval(self, x: list, fs: float, segment: int) -> Iterator[tuple]:
        if x:
            for f, p in zip(*K.welch(np.asarray(x, float), float(fs), int(segment)), strict=True):
                yield float(f), float(p)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL text of ``spark``, under their names."""
    from pulseloom.operators import signal

    def band_power(f: pd.Series, p: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([K.band_power(np.asarray(a, float), np.asarray(b, float), x, y) if a is not None and b is not None else None for a, b, x, y in zip(f, p, low, high, strict=True)])

    def norm_sf(z: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        return z.map(lambda v: erfc(v / sqrt(2)) / 2, na_action="ignore")

    for name, kernel, version in (("samp_en", signal.samp_en, 1), ("samp_en_v2", signal.samp_en, 2), ("ap_en", signal.ap_en, 1), ("ap_en_v2", signal.ap_en, 2)):
        spark.udf.register(name, kernel(version))
    spark.udf.register("band_power", F.pandas_udf(band_power, "double"))
    spark.udf.register("norm_sf", F.pandas_udf(norm_sf, "double"))
    spark.udtf.register("welch_psd", F.udtf(WelchArray, returnType="f double, p double"))
    spark.udtf.register("welch_series", F.udtf(WelchSeries, returnType="rec bigint, k int, f double, p double"))

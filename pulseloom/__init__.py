"""Pulseloom: heart-rate-variability analytics as Spark DataFrame plans."""

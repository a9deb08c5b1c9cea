"""HTTP audit-log analytics on Spark: clean, featurise, scan, score, learn, report."""

__version__ = "0.1.0"

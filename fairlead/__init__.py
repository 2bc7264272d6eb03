"""Vessel-traffic analytics on Spark: DataFrame-to-DataFrame operators over position, event and series tables."""

"""Extreme-value and point-process analytics expressed as Spark plans."""

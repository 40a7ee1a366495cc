"""Findings analytics on Spark: text scans, finding records and their reports."""

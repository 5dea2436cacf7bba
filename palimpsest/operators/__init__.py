"""Detectors and report algebra: functions from tables (DataFrames) to tables."""

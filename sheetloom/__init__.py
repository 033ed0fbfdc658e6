"""Spreadsheet-scale data preparation on Spark.

Every operator takes and returns DataFrames; driver-side work is limited to schemas, rule and filter arguments,
scalar aggregates and pages of at most 500 rows.
"""

from sheetloom.session import build_session, scratch_dir, tune

__all__ = ["build_session", "scratch_dir", "tune"]

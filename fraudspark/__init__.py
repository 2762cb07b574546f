"""Fraud-analytics operators over building, permit and violation records, on Spark."""

"""Complaint-risk analytics as composable PySpark DataFrame operators."""

"""Plumeline: environmental observation analytics as composable Spark DataFrame functions."""

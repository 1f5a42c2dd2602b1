"""Curriculum-graph analytics as Spark batch jobs."""

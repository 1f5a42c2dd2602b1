"""Curriculum tables from files, texts or relational tables."""

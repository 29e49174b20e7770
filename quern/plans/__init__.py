"""Composite jobs and plan helpers."""

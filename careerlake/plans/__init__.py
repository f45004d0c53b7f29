"""Composite jobs and reports built from the operators."""

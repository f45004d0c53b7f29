"""Readers and writers: job documents, CSV extracts, warehouse snapshots."""

"""Readers and writers: typed CSV ingest, sample-table views, result sinks."""

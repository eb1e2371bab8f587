"""Structured Streaming entry points (incremental landing of provider files)."""

from .landing import land_stream, new_files_stream, read_bronze

__all__ = ["land_stream", "new_files_stream", "read_bronze"]

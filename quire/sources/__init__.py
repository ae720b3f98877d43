"""Scans of file dumps and tables, readers of book formats, and sinks."""

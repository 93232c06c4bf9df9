"""Streaming forms, an extension: the reference has no stream."""

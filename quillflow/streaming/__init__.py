"""Resumable, append-style scoring with Structured Streaming."""

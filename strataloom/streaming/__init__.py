"""Structured Streaming: run progress and event windows."""

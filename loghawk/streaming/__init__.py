"""Structured Streaming: score log files as they arrive."""

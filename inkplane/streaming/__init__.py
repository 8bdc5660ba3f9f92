"""Structured Streaming: frame rate and capture region of live sessions."""

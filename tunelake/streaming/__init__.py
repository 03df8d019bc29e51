"""Structured Streaming versions of the log, chat and discovery operators."""

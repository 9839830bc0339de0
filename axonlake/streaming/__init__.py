"""Keyed state over event streams, in batch replay and in Structured Streaming."""

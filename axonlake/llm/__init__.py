"""Operators of large text and ranking pipelines. Nothing outside this subpackage imports it."""

"""Streaming of bibspark."""

"""Operators of bibspark."""

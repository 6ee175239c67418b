"""Functions of bibspark."""

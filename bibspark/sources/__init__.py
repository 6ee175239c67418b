"""Sources of bibspark."""

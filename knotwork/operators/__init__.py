"""The operators of the link-analysis engine."""

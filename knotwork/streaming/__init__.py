"""The streaming of the link-analysis engine."""

"""The sources of the link-analysis engine."""

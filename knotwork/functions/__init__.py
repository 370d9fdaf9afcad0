"""The functions of the link-analysis engine."""

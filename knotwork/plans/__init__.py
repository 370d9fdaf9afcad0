"""The plans of the link-analysis engine."""

"""Types, comparison families and aggregates."""

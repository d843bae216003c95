"""User-facing queries."""

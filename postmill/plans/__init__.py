"""End-to-end runs over stored tables."""

"""Key helpers and small column functions."""

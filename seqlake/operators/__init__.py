"""DataFrame operators over a mutation log."""

"""DataFrame operators of the walking graph."""

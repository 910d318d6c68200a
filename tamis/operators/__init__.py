"""DataFrame operators of document scoring."""

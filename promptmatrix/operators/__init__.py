"""DataFrame operators over cases, cells and results."""

"""DataFrame-level operators over reads, pairs, edges and dictionaries."""

"""Column-level functions: encoding, quality scores and alignment."""

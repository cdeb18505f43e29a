"""Column expressions: sky geometry, statistics and classifications."""

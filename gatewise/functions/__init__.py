"""Column-expression libraries shared by batch and streaming jobs."""

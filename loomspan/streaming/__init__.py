"""No operator here needs unbounded input: all sources are complete files, so batch plans are used throughout."""

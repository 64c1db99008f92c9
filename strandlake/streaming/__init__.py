"""Structured Streaming forms of the detectors, the replay guard and the extent journal."""

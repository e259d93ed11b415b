"""Structured Streaming entry points (the reference is batch only; this scores
arriving rows against static prototypes with the batch operators unchanged)."""

"""Readers into the canonical utterance table, and sinks."""

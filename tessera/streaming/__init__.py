"""Structured Streaming forms of the roll-ups and stores."""

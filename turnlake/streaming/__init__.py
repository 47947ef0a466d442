"""Structured Streaming forms of capture, roll-ups and turn pairing."""

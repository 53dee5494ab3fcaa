"""Scoring a stream: the same stateless functions on a streaming frame."""

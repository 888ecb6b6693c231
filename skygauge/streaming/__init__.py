"""Structured Streaming: the alert stream over topic records and the stateful gate."""

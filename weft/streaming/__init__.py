"""Structured Streaming: segment state, stable prefixes, alias state, event windows."""

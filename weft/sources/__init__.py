"""Readers and writers: typed CSV and JSON, newest artifacts, archives, merges."""

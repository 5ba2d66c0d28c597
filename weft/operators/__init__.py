"""Relational operators over DataFrames: retrieval, ranking, linkage, routing, chunking, evaluation."""

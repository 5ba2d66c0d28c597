"""Column builders: text, similarity, vectors, JSON and spans."""

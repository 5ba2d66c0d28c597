"""weft: entity resolution, retrieval, linkage, routing and evaluation as Spark DataFrame operators."""

"""Part of tidemark; see the README for the list of operators."""

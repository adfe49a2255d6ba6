"""Orderings and symbolic plans of factorizations."""

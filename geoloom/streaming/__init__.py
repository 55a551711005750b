"""Streams of elements: the stateless part of the pipeline over files as they arrive."""

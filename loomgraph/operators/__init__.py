"""Operators over code: index, graph, linkage, resolution, ranking."""

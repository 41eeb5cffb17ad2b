"""Operators put together: analysis of a tree, and an incremental update."""

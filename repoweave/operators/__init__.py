"""Operators over components, edges, modules, pages and snapshots; each takes and returns DataFrames."""

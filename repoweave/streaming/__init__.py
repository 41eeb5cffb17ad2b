"""Streams of edits and snapshots."""

"""Spark-native analytics over source repositories: files, components, edges, modules, pages and their changes."""

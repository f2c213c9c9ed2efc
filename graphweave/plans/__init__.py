"""Tool-shaped queries over a stored graph, and guards for generated ones."""

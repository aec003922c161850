"""operators of the namespace engine."""

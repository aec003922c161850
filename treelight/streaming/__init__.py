"""streaming of the namespace engine."""

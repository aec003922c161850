"""sources of the namespace engine."""

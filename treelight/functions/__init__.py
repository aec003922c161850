"""functions of the namespace engine."""

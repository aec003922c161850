"""plans of the namespace engine."""

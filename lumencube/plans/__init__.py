"""plans of lumencube."""

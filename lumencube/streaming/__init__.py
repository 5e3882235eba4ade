"""streaming of lumencube."""

"""sources of lumencube."""

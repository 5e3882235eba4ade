"""operators of lumencube."""

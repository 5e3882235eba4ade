"""functions of lumencube."""

"""Column helpers: no shuffles, no actions."""

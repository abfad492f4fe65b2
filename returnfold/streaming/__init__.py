"""Series that keep arriving."""

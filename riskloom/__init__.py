"""riskloom."""

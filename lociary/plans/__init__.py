"""User-level operators composed from the building blocks."""

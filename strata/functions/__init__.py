"""Column functions and the few algorithms that need whole sequences in one place."""

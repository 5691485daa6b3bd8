"""Column expressions on text, keys, similarity, time and numbers."""

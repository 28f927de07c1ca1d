"""Column functions: text, vectors, metadata, prompts and replies."""

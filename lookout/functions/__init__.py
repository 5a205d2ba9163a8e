"""Column-level functions: text, signal frames, scalars."""

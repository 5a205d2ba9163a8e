"""Reading and writing tables, text files, recordings and baselines."""

"""Training-data operators over text corpora, each with its registered query."""

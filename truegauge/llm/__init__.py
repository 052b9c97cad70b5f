"""Training-data operators over text, conversations and vectors. Nothing else in the library imports this package."""

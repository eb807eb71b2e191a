"""Training-data operators on documents, pages, conversations and embeddings.

Nothing else in the library imports this subpackage. ``catalog`` lists its
queries and their SQL.
"""

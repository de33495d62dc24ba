"""Training-data operators: thirteen jobs over ``documents`` (doc_id, text, ...) and ``embeddings``.

Nothing else in the library imports this subpackage.
"""

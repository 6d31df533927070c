"""Operators of a training-data pipeline over documents, pages and embeddings. Nothing outside this
folder, ``corpus_pipeline.py`` and the entry file's guard imports it."""

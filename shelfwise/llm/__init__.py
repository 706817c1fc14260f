"""Operators of a training-data pipeline (text, pages, chats, embeddings)."""

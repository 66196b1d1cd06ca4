"""Operators of a training-data pipeline: text quality, privacy, near copies, mixing, licences, pages, vectors, chat, tokens."""

"""Readers and writers of corpora, word lists, rated pairs and models."""

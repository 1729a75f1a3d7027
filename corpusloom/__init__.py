"""Text-corpus preparation and word-embedding evaluation on Spark DataFrames.

A *corpus* is a DataFrame ``(doc_id long, text string)``.  ``doc_id`` is unique
and its order is the corpus order; ``text`` may hold newlines, and a *line* is
the part between two of them.
"""

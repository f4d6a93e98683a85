"""Training-data operators: tokenising, deduplication, mixing, language, toxicity, quality, search and HTML extraction.

Self-contained: nothing outside this folder imports it, and it imports nothing outside it.
"""

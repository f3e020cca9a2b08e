"""Operators that prepare training text: duplicates, quality, URL rules, shards, token counts, WARC, mixtures."""

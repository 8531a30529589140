"""Corpus-preparation operators: tokens, duplicates, languages, licences, leaks, quality, pages, private data, shards."""

"""Corpus-preparation operators: deduplication, tokenisation, filtering, packing and archives."""

"""Training-data operators: chat formatting, extraction, deduplication, scoring, tokens, search."""

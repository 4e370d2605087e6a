"""Training-data operators: archives, scoring, search, dedup, packing, language ID and tokenizers."""

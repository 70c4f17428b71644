"""Training-data operators: archives, token counts, URL filters, vector search, mixing,
subword encoding, chat formatting, near-duplicates, media columns and toxicity."""

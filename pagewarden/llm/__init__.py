"""Training-data operators: secrets, language, media, quality, duplicates, extraction, tokens, leakage."""

"""Training-data operators: fingerprints, chat formatting, toxicity, BPE, joins, mixing, dedup, counts, HTML, quality."""

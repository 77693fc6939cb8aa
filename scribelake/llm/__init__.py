"""Training-data operators: PII, quality, decontamination, toxicity, near-dedup, URL rules, token files, packing,
fingerprints and language identification. Nothing outside this folder imports it."""

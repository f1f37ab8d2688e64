"""DataFrame operators: upserts, selections, projection (PCA), similarity, encoders, tokenizer."""

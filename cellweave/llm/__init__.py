"""Training-data operators (dedup, search, packing, tokenizing). Nothing outside this folder imports it."""

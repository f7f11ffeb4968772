"""Training-data operators (mixing, quality, BPE, language ID, token counts, audio prints,
SimHash, URL rules, coded token files, class n-grams, whitening, pieces, conversation repair).  Nothing outside this folder imports it."""

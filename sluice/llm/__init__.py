"""Training-data operators: language, toxicity, quality, duplicates, tokens, packing, page text.

Nothing outside this subpackage imports it; it may be deleted and the loader still works.
"""

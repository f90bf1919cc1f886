"""Training-data operators: token counts, page text, secrets, personal data, mixing, language,
vector search, near duplicates, TIFF pages and byte-pair ids.

Nothing outside this folder imports it. Every operator takes a DataFrame, reads only the
columns it names, and returns columns of its own, so extra input columns never clash.
"""

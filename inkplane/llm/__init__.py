"""Training-data operators: language ID, mixing, PII, near-duplicates, search, WARC, BPE.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""

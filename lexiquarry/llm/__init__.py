"""Training-data operators: filtering, formatting, deduplication, decontamination, mixing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""

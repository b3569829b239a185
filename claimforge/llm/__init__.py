"""Training-data operators: cleaning, deduplication, decontamination, mixing, tokenisation.

Nothing outside this subpackage imports it. Each module holds one operator; ``registry`` registers the
queries that apply them to whole tables.
"""

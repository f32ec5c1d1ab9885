"""Operators for training data. Nothing outside this folder imports it."""

from palimpsest.llm import boilerplate, conversations, mixing, name_variants, packing, pii, similar_vectors, truncation

MODULES = [boilerplate, conversations, mixing, name_variants, packing, pii, similar_vectors, truncation]

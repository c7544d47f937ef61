"""Training-data operators: token budgets, text quality, mixing, language, code provenance, packing, leakage, sentences.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it can be imported.
"""

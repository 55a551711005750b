"""Training-data operators: near-dedup, PII, decontamination, quality, toxicity, chat, tokens, packing, HTML.

Nothing else in the library imports this subpackage.
"""

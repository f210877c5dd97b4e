"""Training-data operators: sharding, decontamination, mixing, tokens, URLs, HTML, quality, near copies, repetition.

Nothing else in the library imports this subpackage.
"""

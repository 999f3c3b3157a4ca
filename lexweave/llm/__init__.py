"""Training-data operators: token counts, near-duplicates, decontamination and the rest.

Nothing else in the library imports this subpackage.
"""

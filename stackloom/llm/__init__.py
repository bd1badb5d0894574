"""Training-data operators: scoring, de-duplication, decontamination, tokenisation and formatting of text tables.

Nothing else in the library imports this subpackage.
"""

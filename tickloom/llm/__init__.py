"""Training-data operators: dedup, tokenising, filters, classifiers, decontamination.

Nothing else in the library imports this subpackage.
"""

"""Operators of a training-data pipeline (quality, toxicity, extraction, duplicates, decontamination, mixing).

Nothing else in the package imports this subpackage.
"""

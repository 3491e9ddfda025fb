"""Operators for preparing large text corpora: mixing, language, PII, quality, secrets,
near duplicates, tokens, media, toxicity and nearest neighbours.

Nothing else in the library imports this subpackage.
"""

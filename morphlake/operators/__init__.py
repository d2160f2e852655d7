"""Operators on DataFrames: lexicon joins, seen words, registry, scoring, deliveries."""

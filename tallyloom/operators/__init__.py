"""Operators on DataFrames: scoring, pairing, voting, corpora, splits, merges, audits, search."""

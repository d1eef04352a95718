"""Operators over event tables: links, sides, folds, knowledge, votes, upserts."""

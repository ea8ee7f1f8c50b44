"""Operators on DataFrames: ranking, merging, passages, budgets, reranking and the research corpus."""

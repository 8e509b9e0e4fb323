"""Relational, similarity, clustering and graph operators over DataFrames."""

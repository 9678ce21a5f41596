"""Quillon: conversation, form and training-corpus analytics written on Spark DataFrames."""

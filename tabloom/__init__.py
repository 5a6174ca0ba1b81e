"""Tabular modelling and training-data preparation on Spark DataFrames."""

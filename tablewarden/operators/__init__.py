"""Audit and repair operators: DataFrame in, DataFrame out."""

"""Operators on envelopes: DataFrame in, DataFrame out."""

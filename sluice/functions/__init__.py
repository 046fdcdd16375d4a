"""Expressions: a parser, and a compiler from parsed expressions to Spark columns."""

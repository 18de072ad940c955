"""Operators that prepare text and judgements for training; nothing outside this package imports it."""

"""Operators for preparing large text corpora for training; nothing else in the library imports them."""

"""Operators for preparing large text corpora for training. Nothing outside this subpackage imports it."""

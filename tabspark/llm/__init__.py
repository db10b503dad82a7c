"""Operators for large text corpora and very large groups; nothing else in the library imports this subpackage."""

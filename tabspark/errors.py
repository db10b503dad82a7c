"""Errors raised while a plan is built, before any job runs."""


class SchemaError(ValueError):
    """A column is missing, doubled or of the wrong type for the operator that was asked for."""

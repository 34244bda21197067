"""Registered queries over the driver tables."""

from .. import catalogue  # noqa: F401  all plans register in its order, whichever is imported first

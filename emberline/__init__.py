"""Spark library for a two-tier event warehouse."""

from emberline.settings import Settings

__all__ = ["Settings"]

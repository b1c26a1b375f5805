"""Source parsers in plain Python (no Spark): one function from text to records."""

from .records import parse_source

__all__ = ["parse_source"]

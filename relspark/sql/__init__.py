"""The dialect's text: tokens, syntax trees and the parser."""

from relspark.sql.parser import parse

__all__ = ["parse"]

"""SPARQL SELECT queries compiled to DataFrame plans over a quad table."""

from .compiler import select
from .parser import QueryError, guard, parse

__all__ = ["QueryError", "guard", "parse", "select"]

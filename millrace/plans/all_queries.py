"""All registered queries; importing the modules registers them."""

from . import card_queries, file_queries, queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

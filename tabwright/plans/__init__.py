"""Named queries over the driver tables, each with its DuckDB oracle when one exists."""

from . import chat_queries, induce_queries, message_queries  # noqa: F401,I001  (registers queries)
from . import eval_queries, extract_queries, io_queries, unroll_queries  # noqa: F401,E402
from .registry import ORACLES, QUERIES, table  # noqa: F401

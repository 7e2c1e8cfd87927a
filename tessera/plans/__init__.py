"""All queries and their SQL by name."""

from .queries import QUERIES, SQL
from . import coding, timing  # noqa: E402,F401,I001  they add theirs

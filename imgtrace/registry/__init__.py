"""Every operator as a runnable query over the benchmark tables."""

from imgtrace.registry import (  # noqa: F401
    joins, pictures, reports, scalars, search, sets, sources, streams,
)
from imgtrace.registry.base import ORACLE, QUERIES  # noqa: F401

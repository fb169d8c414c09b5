"""Imports every module that registers queries."""

from triagelake.plans import text_queries  # noqa: F401
from triagelake.plans import agg_queries  # noqa: F401
from triagelake.plans import join_queries  # noqa: F401
from triagelake.plans import whole_queries  # noqa: F401
from triagelake.plans import stream_queries  # noqa: F401

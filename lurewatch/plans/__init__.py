"""Registered queries: importing this package fills ``REGISTRY``."""

from lurewatch.plans.registry import REGISTRY  # noqa: F401
from lurewatch.plans import (  # noqa: F401, E402
    detection_queries,
    eval_queries,
    intel_queries,
    learning_queries,
    report_queries,
    investigation_queries,
    session_queries,
    store_queries,
    stream_queries,
    text_queries,
    url_queries,
)

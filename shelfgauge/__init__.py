"""Quality scoring and enrichment of supplier product feeds on Spark."""

from shelfgauge.operators import (
    DEFAULT_RULES,
    Rule,
    analyse,
    batch_requests,
    enrich,
    merge_results,
    summarise,
    with_batch_id,
    with_pre_score,
)
from shelfgauge.sources import conform, read_feed, write_feed

__all__ = [
    "DEFAULT_RULES",
    "Rule",
    "analyse",
    "batch_requests",
    "conform",
    "enrich",
    "merge_results",
    "read_feed",
    "summarise",
    "with_batch_id",
    "with_pre_score",
    "write_feed",
]

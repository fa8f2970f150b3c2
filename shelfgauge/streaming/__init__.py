"""Structured Streaming entry points."""

from shelfgauge.streaming.feeds import score_stream, stream_feed, write_enriched, write_scores
from shelfgauge.streaming.figures import figures_of, write_figures
from shelfgauge.streaming.files import (
    batch_files, changed_products, feed_of_files, score_files, stream_files, write_changes, write_files,
)

__all__ = [
    "batch_files",
    "changed_products",
    "feed_of_files",
    "figures_of",
    "score_files",
    "score_stream",
    "stream_feed",
    "stream_files",
    "write_changes",
    "write_enriched",
    "write_figures",
    "write_files",
    "write_scores",
]

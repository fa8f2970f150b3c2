"""Operators on feeds: scoring, batching, model results, merging, summaries and views."""

from shelfgauge.operators.batching import batch_sizes, by_category, with_batch_id, with_position
from shelfgauge.operators.enrichment import analyse, enrich, responses_of, run_metrics
from shelfgauge.operators.merging import first_results, merge_results
from shelfgauge.operators.requests import batch_products, batch_requests
from shelfgauge.operators.responses import (
    parse_responses,
    resolve_results,
    result_rows,
    stub_rows,
    usable_responses,
    validate_responses,
    with_items,
)
from shelfgauge.operators.scoring import (
    DEFAULT_RULES,
    Rule,
    absent,
    flaw_profile,
    pre_grade_profile,
    with_pre_score,
)
from shelfgauge.operators.summary import (
    Summary,
    grade_distribution,
    missing_attribute_frequency,
    needs_review,
    summarise,
    summary_scalars,
    worst_products,
    zero_filled_counts,
)
from shelfgauge.operators.views import (
    before_after,
    find_products,
    first_products,
    missing_badges,
    preview,
    product_badges,
    results_view,
    title_comparison,
)

__all__ = [
    "DEFAULT_RULES",
    "Rule",
    "Summary",
    "absent",
    "analyse",
    "batch_products",
    "batch_requests",
    "batch_sizes",
    "before_after",
    "by_category",
    "enrich",
    "run_metrics",
    "find_products",
    "first_products",
    "first_results",
    "flaw_profile",
    "grade_distribution",
    "merge_results",
    "missing_attribute_frequency",
    "missing_badges",
    "needs_review",
    "parse_responses",
    "pre_grade_profile",
    "preview",
    "product_badges",
    "resolve_results",
    "responses_of",
    "result_rows",
    "results_view",
    "stub_rows",
    "summarise",
    "summary_scalars",
    "title_comparison",
    "usable_responses",
    "validate_responses",
    "with_batch_id",
    "with_items",
    "with_position",
    "with_pre_score",
    "worst_products",
    "zero_filled_counts",
]

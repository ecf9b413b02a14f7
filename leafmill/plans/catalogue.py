"""All queries over the reference tables, by name, with equivalent DuckDB SQL."""

from leafmill.plans import batch_queries, file_queries, flow_queries, grid_queries, judge_queries, metric_queries, quality_queries, reader_queries  # noqa: F401
from leafmill.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "text_verdict"

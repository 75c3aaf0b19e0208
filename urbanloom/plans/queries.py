"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import adapter_queries, dataset_queries, graph_queries, metric_queries, path_queries, record_queries, report_queries, spatial_queries, subgraph_queries, walk_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

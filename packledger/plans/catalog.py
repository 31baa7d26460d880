"""All registered queries."""
from . import (  # noqa: F401
    q_browse, q_crawl, q_models, q_people, q_prices, q_reports, q_specs, q_tables)
from .registry import ORACLE, QUERIES  # noqa: F401

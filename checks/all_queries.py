"""Loads every check module, which fills the registry."""

from . import entity_checks, page_checks, plan_checks, query_checks, run_checks, score_checks, serve_checks, stream_checks  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

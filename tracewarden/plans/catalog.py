"""All registered queries; importing this module fills the registry."""

import importlib

from tracewarden.plans.registry import ORACLES, QUERIES

for _module in ("feature_queries", "source_queries", "scan_queries", "text_queries", "traffic_queries", "model_queries"):
    importlib.import_module(f"tracewarden.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]

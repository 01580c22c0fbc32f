"""Imports every query module so their ``register`` calls populate the registry."""

from __future__ import annotations

from tessera.plans import (association_queries, component_queries, contract_queries, distribution_queries,  # noqa: F401
                           explore_queries,
                           io_queries, model_queries,
                           prep_queries, profile_queries, recommend_queries)
from tessera.plans.registry import REGISTRY


def all_queries():
    return dict(REGISTRY)


def flagship(spark, sf_dir):
    """prepare_task on orders: stratified split, recipe fitted on train only, applied to all."""
    return prep_queries.q_prepare(spark, sf_dir)

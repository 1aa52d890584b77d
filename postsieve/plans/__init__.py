"""Whole jobs composed of the operators: a polling run and an endpoint audit."""

from postsieve.plans.audit import audit
from postsieve.plans.polling import RunConfig, RunResult, drain_queue, new_listings, run_batch

__all__ = ["RunConfig", "RunResult", "audit", "drain_queue", "new_listings", "run_batch"]

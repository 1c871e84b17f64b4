"""Registered queries: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from alertloom.plans import context_queries, cube_queries, habit_queries, health_queries, hierarchy_queries, lattice_queries, model_queries, noise_queries, policy_queries, rhythm_queries, scope_queries, sketch_queries, source_queries

QUERIES: dict = noise_queries.QUERIES | cube_queries.QUERIES | health_queries.QUERIES | policy_queries.QUERIES | rhythm_queries.QUERIES | source_queries.QUERIES | context_queries.QUERIES | habit_queries.QUERIES | scope_queries.QUERIES | lattice_queries.QUERIES | model_queries.QUERIES | hierarchy_queries.QUERIES | sketch_queries.QUERIES

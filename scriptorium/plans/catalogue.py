"""All queries of the core engine, by name, with their SQL."""

from __future__ import annotations

from scriptorium.plans import answer_queries, corpus_queries, entity_queries, hierarchy_queries, repair_queries, search_queries, service_queries, store_queries

FAMILIES = [hierarchy_queries, corpus_queries, entity_queries, repair_queries, search_queries, store_queries, answer_queries, service_queries]

QUERIES = {name: f for family in FAMILIES for name, f in family.QUERIES.items()}
SQL = {name: text for family in FAMILIES for name, text in family.SQL.items()}

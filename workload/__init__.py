"""Every operator wired to the test tables, each with the SQL that checks it."""

from workload import diet_queries, kept, loaders, marts, pricing, relations, stored, targets

MODULES = [marts, pricing, relations, targets, diet_queries, loaders, stored, kept]

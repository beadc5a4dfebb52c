"""Query model and the catalog of registered queries."""

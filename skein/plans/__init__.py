"""Registered queries: operators applied to the projected graph, each beside the SQL that defines its result."""

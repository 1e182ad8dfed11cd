"""Registered queries: each operator over the whole given tables, with the SQL it must agree with."""

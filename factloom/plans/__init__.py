"""Registered queries: relations built from the given tables, an operator over them, and the SQL for the same rows."""

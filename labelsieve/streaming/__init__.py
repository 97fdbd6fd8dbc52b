"""Audits of tables that grow."""

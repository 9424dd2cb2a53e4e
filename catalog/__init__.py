"""Registered queries on the order tables and their SQL counterparts."""

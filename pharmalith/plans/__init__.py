"""Registered queries of the library's operators, and their SQL counterparts."""

"""Registered queries, their SQL counterparts and the end-to-end job."""

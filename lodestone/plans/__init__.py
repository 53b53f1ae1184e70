"""Registered queries with their SQL equivalents, and the ingest job."""

"""Structured Streaming ingest of request documents into the ledger store."""

from tillbook.streaming.ingest import start_ingest

__all__ = ["start_ingest"]

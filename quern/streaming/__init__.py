"""Structured Streaming: file ingest, event windows, stateful rates."""

from .events import ewma_stream, sessions, sliding, tumbling
from .ingest import ingest_stream, quarantine_split

__all__ = ["ewma_stream", "ingest_stream", "quarantine_split", "sessions", "sliding", "tumbling"]

"""Landed payloads to posting rows, one function per board platform."""

from jobsluice.sources import (  # noqa: F401  (register themselves)
    documents,
    json_boards,
    markup_boards,
)

"""Incremental (streaming) runs."""

from .incremental import run_incremental  # noqa: F401

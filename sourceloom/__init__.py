"""Source-corpus and commit analytics as Spark DataFrame jobs."""

from sourceloom.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]

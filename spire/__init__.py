"""spire: conversational sparse retrieval analytics on Spark DataFrames."""

from .session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]

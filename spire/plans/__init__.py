"""Registered queries (one per operator of the survey) and their oracle SQL."""

from .registry import ORACLE, QUERIES


def load_all() -> None:
    """Import every query module so its queries register."""
    from . import q_retrieval  # noqa: F401
    for mod in ("q_metrics", "q_index", "q_runs", "q_conv", "q_lexical", "q_distill", "q_logs", "q_stream", "q_io", "q_corpora"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{mod}":
                raise


__all__ = ["ORACLE", "QUERIES", "load_all"]

"""Event-timeline analytics expressed with Spark DataFrames."""

from chronoline.session import build_session
from chronoline.settings import Settings

__all__ = ["Settings", "build_session"]

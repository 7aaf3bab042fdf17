"""Species-screening analytics expressed as Spark DataFrame operators."""

from biosieve.session import get_session

__all__ = ["get_session"]

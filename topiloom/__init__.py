"""Structure-aware topic analytics as Spark DataFrame jobs."""

from .config import TopicConfig

__all__ = ["TopicConfig"]

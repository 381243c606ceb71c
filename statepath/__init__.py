"""Learn, solve and evaluate discrete decision processes from event tables."""

from statepath.config import Config

__all__ = ["Config"]

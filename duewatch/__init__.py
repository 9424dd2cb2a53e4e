"""duewatch: Spark-native audit, training, ranking and evaluation for rare late responses."""

from .config import StudyConfig

__all__ = ["StudyConfig"]

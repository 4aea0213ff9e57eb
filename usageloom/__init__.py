"""Spark-native analytics over AI command-line token usage."""

from usageloom.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]

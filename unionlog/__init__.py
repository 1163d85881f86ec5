"""unionlog: a Spark-native grow-only set of byte strings, and queries over it."""

__version__ = "0.1.0"

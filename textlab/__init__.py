"""textlab: labelled-text corpus analytics and classifier evaluation on Spark."""

__version__ = "0.1.0"

"""marlstone: a SQL workbench, banking analytics and text-corpus engine on Spark."""

__version__ = "0.1.0"

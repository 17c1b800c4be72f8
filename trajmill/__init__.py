"""trajmill: rollout tables in, training sets and evaluation reports out, on Spark."""

__version__ = "0.1.0"

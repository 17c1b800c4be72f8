"""Incremental ingestion of rollouts."""

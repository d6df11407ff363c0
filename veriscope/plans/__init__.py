"""Configurations, model access and the question pipeline."""

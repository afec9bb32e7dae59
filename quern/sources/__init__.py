"""Readers of tables, logs, samples and configurations, and their writers."""

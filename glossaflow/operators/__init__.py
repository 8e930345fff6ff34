"""Dimension tables (models, prompts), requests to and responses from services."""

"""Roles, input checks, training, scoring and the model registry."""

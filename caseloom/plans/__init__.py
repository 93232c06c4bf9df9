"""Inputs, composite pipelines, registered queries and their SQL."""

"""Queries, dataset builders and trainers."""

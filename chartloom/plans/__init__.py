"""Queries over the tables of a data folder."""

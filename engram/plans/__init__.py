"""Composed plans: the views that map the test tables to the data model, and the catalogue of queries."""

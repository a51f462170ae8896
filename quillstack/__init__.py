"""Catalog and data-processing jobs written with the DataFrame API."""

"""Readers that turn files, pages and tables into documents."""

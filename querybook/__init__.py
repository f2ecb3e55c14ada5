"""Queries over the driver tables, each next to the SQL that must give the same rows."""

from querybook.base import BOOK
from querybook import cleaning, credibility, emotions, inputs, modelling, runs, summaries, texts  # noqa: F401


def queries():
    return {name: entry.run for name, entry in BOOK.items()}


def oracle_sql():
    return {name: entry.sql for name, entry in BOOK.items() if entry.sql}

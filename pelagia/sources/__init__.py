"""Readers and writers of survey files."""

from pelagia.sources.xlsx import read_xlsx, write_xlsx  # noqa: F401

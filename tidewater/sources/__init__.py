"""Readers and writers: tables, log archives, feeds, filings, series."""

"""Landed payloads in, tables in and out."""

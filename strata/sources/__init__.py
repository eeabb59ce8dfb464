"""Readers: tables, document JSON with strict schemas, HTML blocks."""

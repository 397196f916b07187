"""Readers and writers for ledgers, bank files and card statements."""

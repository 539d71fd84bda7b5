"""Readers and writers of operation logs."""

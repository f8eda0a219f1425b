"""Readers, writers, paths and folders."""

"""Readers of files, folders, sheets and archives, and the sinks for what comes out."""

"""Readers and writers: log exports, transcripts, growing files, the append-only store."""

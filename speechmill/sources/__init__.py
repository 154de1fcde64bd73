"""Readers and writers: WAV files, text and JSON, curves, manifests."""

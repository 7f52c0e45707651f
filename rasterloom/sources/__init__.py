"""Readers and writers: binary containers, scripts, raw frames, text manifests."""

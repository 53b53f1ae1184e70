"""Readers and writers: transcripts, notes, manifests, weights, events, pages."""

"""Readers and writers: captions, images, metadata, index tables and scratch tables."""

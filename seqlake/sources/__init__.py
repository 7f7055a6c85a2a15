"""Durable storage of mutation logs: manifest, store, backup and repair."""

"""Queries over an archive: lookups, ancestry, resolution, checks, readiness, manifests, retention, documents."""

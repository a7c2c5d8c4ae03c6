"""Readers of facts: source trees, manifests, registries."""

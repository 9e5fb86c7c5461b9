"""Readers and writers for scans, manifests and registry tables."""

"""Readers for raw exports."""
from punctua.sources.files import discover, load_raw, manifest, normalize_schema  # noqa: F401

"""The library's kept tables, by the name that the operators use."""

from veilstone.tables import discard, keep, release, shared_dir, working_folder

__all__ = ["discard", "keep", "release", "shared_dir", "working_folder"]

"""Part of papyra."""

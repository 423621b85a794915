"""What release() gives back."""

from __future__ import annotations

from papyra.llm import common


def test_trim(spark):
    """The driver's JVM is asked to give free native memory back; where it has no such command, nothing is raised."""
    said = common.trim(spark)
    assert said is None or "Trim native heap" in said

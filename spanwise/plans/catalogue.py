"""All queries outside the optional subpackages, by name."""

from __future__ import annotations

from spanwise.plans import data_problems, formats, profiles, texts

FLAGSHIP = "clips_per_user"


def queries() -> dict:
    return {**data_problems.QUERIES, **profiles.QUERIES, **formats.QUERIES, **texts.QUERIES}


def oracles() -> dict:
    return {**data_problems.ORACLES, **profiles.ORACLES, **formats.ORACLES, **texts.ORACLES}

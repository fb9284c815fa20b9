"""Helpers that several tests share; ``conftest`` is no place for them, as there are two modules of that name."""

from datetime import datetime, timezone


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc) if text else None

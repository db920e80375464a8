"""Settings of the driver: lines of name=value."""

from __future__ import annotations

from collections.abc import MutableMapping


def read_settings(text: str, into: MutableMapping[str, str]) -> list[str]:
    """Puts the settings of ``text`` into ``into`` where they are not set yet, and returns the names put there.

    Blank lines, comments and lines without a name or an equals sign are skipped; a value may hold further equals signs.
    """
    named = (line.strip().partition("=") for line in text.splitlines() if not line.lstrip().startswith("#"))
    added = []
    for name, sign, value in ((n.strip(), s, v.strip()) for n, s, v in named):
        if name and sign and name not in into:
            into[name] = value
            added.append(name)
    return added

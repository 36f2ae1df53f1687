"""Plain computations that the tests compare with."""

import re

from tests.llm.conftest import ROWS  # noqa: F401


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def groups_of(sets):
    """For every place, the places that links reach from it."""
    links = [[k for k, o in enumerate(sets) if s and 100 * len(s & o) >= 80 * len(s | o)] for s in sets]
    found = []
    for place in range(len(sets)):
        seen, todo = {place}, [place]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        found.append(seen)
    return found

"""Session code names, Adjective-Noun."""

from __future__ import annotations

import random
from collections.abc import Collection

ADJECTIVES = "Able Airy Blue Brisk Broad Clear Cool Crisp Early Even Fair Fine Fleet Fresh Glad Green Hardy High Light Mild Neat New Open Plain Quick Ready Sound Spry Still Stout Sure Tall Tidy Warm Wide".split()
NOUNS = "Alder Anchor Arch Barge Bay Birch Bridge Cape Cliff Dale Delta Dune Ferry Field Gate Glen Grove Gull Heath Hill Isle Lake Lark Ledge Marsh Mill Oar Peak Pier Pond Reed Ridge Rook Sail Shore Tern Vale Weir".split()


def generate_session_id(taken: Collection[str] = (), rng: random.Random | None = None) -> str:
    """A name that is not taken; when plain names run out, one with a number from 100 to 999, and more digits if need be."""
    rng, used = rng or random.Random(), set(taken)
    for _ in range(200):
        if (name := f"{rng.choice(ADJECTIVES)}-{rng.choice(NOUNS)}") not in used:
            return name
    top = 999
    while (name := f"{rng.choice(ADJECTIVES)}-{rng.choice(NOUNS)}-{rng.randint(100, top)}") in used:
        top += 1
    return name

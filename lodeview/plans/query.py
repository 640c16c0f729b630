"""Analysis of a free-text question, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Words that carry no meaning in a question.
STOP_WORDS = frozenset(
    "a an the of is are was were be been being and or but about with for to in on at by from my your our his her its their this that these those "
    "do does did have has had what where when why how who whom i me we us you he she it they them".split()
)
# Words that hint at a kind of source.
HINTS = {
    "repo": ["repo", "repository"],
    "image": ["image", "images", "photo", "photos", "picture", "pictures", "pic"],
    "pdf": ["pdf", "document", "documents"],
    "screenshot": ["screenshot", "screenshots", "screen shot", "screen shots"],
    "download": ["download", "downloads", "downloaded"],
}


def stem(token: str) -> str:
    return token[:-1] if len(token) >= 4 and token.endswith("s") and not token.endswith(("ss", "us", "is")) else token


def meaningful(tokens: list[str]) -> list[str]:
    """Without stop words, unless nothing else is there."""
    return [t for t in tokens if t not in STOP_WORDS] or tokens


def separated(text: str) -> str:
    return re.sub(r"[-_/\\.]+", " ", text)


@dataclass(frozen=True)
class Question:
    """A question's normal form and the word lists that the search uses."""

    raw: str
    text: str
    words: tuple[str, ...]
    stems: tuple[str, ...]
    hints: tuple[str, ...]

    @property
    def index_terms(self) -> list[list[str]]:
        """For each stem the index tokens it stands for; the last one is a prefix.

        Marks inside a stem split it into adjacent tokens, and a stem of marks alone is left out.
        """
        found = [[t for t in re.split(r"[^a-z0-9]+", re.sub(r"[^a-z0-9_-]", "", s)) if t] for s in self.stems]
        return [t for t in found if t]


def analyse(raw: str) -> Question:
    text = raw.strip().lower()
    words = meaningful(text.split()) if text else []
    hints = tuple(h for h, names in HINTS.items() if any(n in text for n in names))
    return Question(raw, text, tuple(words), tuple(dict.fromkeys(map(stem, words))), hints)

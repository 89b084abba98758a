"""Word lists and character classes shared by the Spark expressions and the SQL oracle.

Everything here is a fixed value that must equal the original application's
choices for results to agree; they are stated plainly, in natural order.
The large Spanish stop-word list itself is not copied: it is Spark's own
``StopWordsRemover`` resource, kept in ``stopwords_spanish.txt``.
"""

from __future__ import annotations

import functools
import os

# ---- fixed values -----------------------------------------------------------
# Extra stop words (slang) added to the Spanish list.
EXTRA_STOPWORDS = ("q", "wtf", "csm", "bla", "blah", "xq", "etc", "vs", "xd", "jajajajjajajajajaa")
# Laughter added to the stop words: "ja" repeated 1..6 times.
LAUGHTER_STOP_SEED, LAUGHTER_STOP_MAX = "ja", 6
# Laughter seeds blanked by the entity cleaner, each repeated 1..5 times.
LAUGHTER_SEEDS = ("ja", "JA", "js", "aj", "AJ", "JS", "je", "JE", "ji", "JI", "Jajajaja", "Jajaja")
LAUGHTER_MAX = 5
# Accent folding: each character of the first string maps to the same position of the second.
ACCENTS_FROM = "áéíóúüçåã\n"
ACCENTS_TO = "aeiouucaa "
# Characters turned into spaces by the v2 cleaner (digits 0-9 included).
PUNCTUATION_CHARS = "0123456789$¢’€*|»“”《》«#…@:𝑿𝒀✓`´{};_•·‘’¨^—–-+=/°¿?¡%!\"'.,[]\\()&"
# Emoji / pictograph code-point ranges removed by the cleaners.
EMOJI_RANGES = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x2300, 0x23FF),
                (0xFE00, 0xFE0F), (0x200D, 0x200D), (0x20E3, 0x20E3), (0xE0020, 0xE007F),
                (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299),
                (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x203C, 0x203C), (0x2049, 0x2049),
                (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x21AA))
# Unicode whitespace (what Python's str.split() splits on).
WHITESPACE_RANGES = ((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                     (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                     (0x3000, 0x3000))
# Small-cluster threshold and seed of the clustering family.
MIN_CLUSTER_SIZE = 4
RANDOM_SEED = 12345678
# -----------------------------------------------------------------------------


def _cp(c: int) -> str:
    return "\\x{%X}" % c


def char_class(ranges, negate: bool = False) -> str:
    """Regex class from code-point ranges in ``\\x{..}`` form (same in Java and RE2)."""
    body = "".join(_cp(a) if a == b else f"{_cp(a)}-{_cp(b)}" for a, b in ranges)
    return f"[{'^' if negate else ''}{body}]"


WS_RE = char_class(WHITESPACE_RANGES) + "+"
EMOJI_RE = char_class(EMOJI_RANGES)
PUNCT_RE = char_class(sorted({(ord(c), ord(c)) for c in PUNCTUATION_CHARS}))


def fold_accents_py(s: str) -> str:
    return s.translate(str.maketrans(ACCENTS_FROM, ACCENTS_TO))


@functools.lru_cache(maxsize=None)
def spark_default_stopwords(language: str = "spanish") -> tuple[str, ...]:
    """Spark ML's default stop words for a language, kept as a plain file beside this module."""
    path = os.path.join(os.path.dirname(__file__), f"stopwords_{language}.txt")
    with open(path, encoding="utf-8") as f:
        return tuple(w for w in f.read().split("\n") if w and not w.startswith("#"))


@functools.lru_cache(maxsize=None)
def stopwords() -> tuple[str, ...]:
    """H5: Spanish stop words ∪ slang ∪ their accent-folded forms ∪ laughter (sorted)."""
    base = set(spark_default_stopwords("spanish")) | set(EXTRA_STOPWORDS)
    folded = {fold_accents_py(w) for w in base}
    laughter = {LAUGHTER_STOP_SEED * i for i in range(1, LAUGHTER_STOP_MAX + 1)}
    return tuple(sorted(base | folded | laughter))


@functools.lru_cache(maxsize=None)
def unwanted_words() -> tuple[str, ...]:
    """H9: stop words ∪ laughter patterns (seeds × 1..5)."""
    laughter = {s * i for s in LAUGHTER_SEEDS for i in range(1, LAUGHTER_MAX + 1)}
    return tuple(sorted(set(stopwords()) | laughter))


def sql_str_list(words) -> str:
    """A SQL list literal of strings (for the oracle)."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"

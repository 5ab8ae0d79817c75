"""Plain versions that more than one test module uses."""

import re

from test_simhash import brute_classes, brute_print, signed

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
__all__ = ["brute_classes", "brute_hits", "signed_print"]


def signed_print(text):
    return signed(brute_print(text))


def brute_hits(text, items, window=10):
    words = lambda t: WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    own = " " + " ".join(words(text)) + " "
    for item in map(words, items):
        m = min(window, len(item))
        if m and any(" " + " ".join(item[i : i + m]) + " " in own for i in range(len(item) - m + 1)):
            return True
    return False

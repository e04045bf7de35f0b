"""Odd texts and plain counterparts of what operators do."""

import re

#: Texts that every operator must stand: null, empty, blank, one word, long, other scripts, repeated.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))
TEXTS = [None, "", " \n\t ", "a", "One two three four five six seven eight nine ten eleven twelve", LONG, "漢字 и é ́ ​ x", "same text again and again", "same text again and again", "x" * 5000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, k):
    words = WORD.findall(lower(text))
    if len(words) >= k:
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    return {tuple(words)} if words else set()

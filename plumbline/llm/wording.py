"""Wording without differences of writing, and near-sameness of wordings.

A wording is the list of words of a text, or of the values of a JSON text, that is left when letter
case, punctuation, white space, character form, invisible characters, JSON and HTML escapes and markup
are taken away. A Chinese, Japanese or other character of a script without spaces is a word of its own.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata

import numpy as np
import xxhash

UNSPACED = "々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"\\/]))")
EDGES = "﻿ \t\r\n"


def leaves(value, out: list) -> list:
    """The values of a JSON value in order; objects in the order of their keys' names."""
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict):
        for k in sorted(value):
            leaves(value[k], out)
    elif isinstance(value, list):
        for x in value:
            leaves(x, out)
    elif value is not None:
        out.append(json.dumps(value))
    return out


def values(text: str | None) -> list[str]:
    """The values of a JSON text, else the text itself."""
    if not text or not (text := text.strip(EDGES)):
        return []
    if text[0] in '{["':
        try:
            found = json.loads(text, strict=False)
        except (ValueError, RecursionError):
            return [text]
        if isinstance(found, str) and found[:1] in '{["' and found != text:
            return values(found)
        return leaves(found, [])
    return [text]


def without_comments(value: str) -> str:
    """A value without <!-- comments -->; one that never ends is no comment. One pass."""
    out, at = [], 0
    while (a := value.find("<!--", at)) >= 0 and (b := value.find("-->", a + 4)) >= 0:
        out += (value[at:a], " ")
        at = b + 3
    return "".join((*out, value[at:])) if out else value


def plain(value: str) -> str:
    """One value without escapes, markup and invisible characters, in one case and form."""
    if value.isascii() and "&" not in value and "<" not in value and "\\" not in value:
        return value.lower()
    if "&" in value:
        value = html.unescape(html.unescape(value))
    if "\\" in value:
        value = ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", value)
    value = INVISIBLE.sub("", value)
    if "<" in value:
        value = MARKUP.sub(" ", without_comments(value))
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", value).casefold())


def words(text: str | None) -> list[list[str]]:
    """The words of each value; values without words are left out."""
    return [w for v in values(text) if (w := TOKEN.findall(plain(v)))]


_KNOWN: dict[str, int] = {}


def word_hash(word: str) -> int:
    """A 63-bit hash of a word, kept for the words met most lately."""
    h = _KNOWN.get(word)
    if h is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        h = _KNOWN[word] = xxhash.xxh3_64_intdigest(word) >> 1
    return h


def hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hash, tokens), np.int64, len(tokens))


MIX = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    u = h.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ u[i : i + n]) * MIX
            out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The words to change, drop or add to turn a into b; most + 1 if more than most (a band of the table)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    s = 0
    n = min(len(a), len(b))
    if n:
        d = np.flatnonzero(a[:n] != b[:n])
        s = int(d[0]) if len(d) else n
    a, b = a[s:], b[s:]
    n = min(len(a), len(b))
    if n:
        d = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        e = int(d[0]) if len(d) else n
        a, b = a[: len(a) - e], b[: len(b) - e]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    return _furthest(a.tolist(), b.tolist(), most)


def _furthest(a: list, b: list, most: int) -> int:
    """Furthest-reaching diagonals: O(length + most squared)."""
    la, lb = len(a), len(b)
    reach = {0: 0}
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    reach = {0: i}
    if i == la and i == lb:
        return 0
    for e in range(1, most + 1):
        new = {}
        for k in range(-e, e + 1):  # k = place in b - place in a
            x = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            if x < 0:
                continue
            x = min(x, la)
            if x + k > lb:
                x = lb - k
            if x < 0:
                continue
            while x < la and x + k < lb and a[x] == b[x + k]:
                x += 1
            new[k] = x
            if x == la and x + k == lb:
                return e
        reach = new
    return most + 1


def within(a: np.ndarray, b: np.ndarray, least: int, share: int = 8) -> int:
    """The same of a within b (b's head and tail are free), for texts that carry another; len(a) + 1 if more than one word in share."""
    most = len(a) // share
    if len(b) < len(a) - most:
        return len(a) + 1
    prev = np.zeros(len(b) + 1, np.int32)
    steps = np.arange(len(b) + 1, dtype=np.int32)
    for i, x in enumerate(a, 1):
        cur = np.empty_like(prev)
        cur[0] = i
        cur[1:] = np.minimum(prev[:-1] + (b != x), prev[1:] + 1)
        cur = np.minimum.accumulate(cur - steps) + steps
        prev = cur
        if prev.min() > most:
            return len(a) + 1
    return int(prev.min())


def arrange(parts: list[np.ndarray], other: np.ndarray) -> list[np.ndarray]:
    """The orders of a record's values to compare: as they stand, and as their words lie in the other record."""
    if len(parts) < 2:
        return [np.concatenate(parts)] if parts else [np.empty(0, np.int64)]
    place: dict[int, int] = {}
    for i, g in enumerate(window_hashes(other, min(3, max(1, len(other)))).tolist()):
        place.setdefault(g, i)
    k = min(3, max(1, len(other)))
    keys = []
    for n, p in enumerate(parts):
        at = [place[g] - i for i, g in enumerate(window_hashes(p, k).tolist()) if g in place]
        keys.append((float(np.median(at)) if at else float("inf"), n))
    order = sorted(range(len(parts)), key=lambda n: keys[n])
    out = [np.concatenate(parts)]
    if order != list(range(len(parts))):
        out.append(np.concatenate([parts[n] for n in order]))
    return out


def near_same(a: list[np.ndarray], b: list[np.ndarray], share: int = 8) -> bool:
    """Whether at most one word in share differs, over the values, whatever the order of the fields; the same whichever text comes first."""
    la, lb = sum(map(len, a)), sum(map(len, b))
    most = max(la, lb) // share
    if not la or not lb or abs(la - lb) > most:
        return False
    return _arranged(a, b, most) or (len(a) > 1 or len(b) > 1) and _arranged(b, a, most)


def _arranged(a: list[np.ndarray], b: list[np.ndarray], most: int) -> bool:
    whole_b = np.concatenate(b)
    for x in arrange(a, whole_b):
        for y in arrange(b, x):
            if distance(x, y, most) <= most:
                return True
    return any(distance(x, whole_b, most) <= most for x in arrange(a, whole_b))

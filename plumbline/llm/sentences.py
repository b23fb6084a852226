"""Sentence boundaries across languages and scripts.

Document-centred disambiguation: what a full stop means is first asked of the document itself (is the
word before it met elsewhere in the document before a lower-case word or a comma, is the word after it
met in lower case, else it may be a proper name), then of the corpus (what follows the stops of a word over all documents, and
whether a short word ever stands without one), and only where neither tells of a list of well-known abbreviations.
Terminators, line breaks and spaces follow the script.

Two passes over the texts. The first sums word counts (partial sums per batch, then one small shuffle
of word types). Only types that hold at least one part in ``SHARE`` of the counted tokens are kept as
corpus evidence, so the table sent to the workers has at most ``SHARE`` rows per kind at any corpus
size. The second pass is a map without a shuffle.

Null, empty and blank texts give no rows; a text without any terminator is one sentence per block.
Repeated documents give the same rows under each id; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: Of a longer run without white space only so many characters before a stop are looked at: it is no abbreviation, and the work stays linear.
LONG = 1000
#: Letters of a type that is an abbreviation by hardly ever standing without a stop.
SHORT = 6
#: A word type counts as corpus evidence if it holds at least 1/SHARE of the tokens of its kind.
SHARE = 50_000

# Abbreviations known beforehand, the last resort where neither document nor corpus tells.
# Those that stand before what they belong to and so never end a sentence:
BEFORE = set(
    "mr mrs ms dr ee prof st mt no nos fig figs sec ch vol pp cf vs e.g i.e approx min max ca gen col lt sgt rev hon capt "
    "nr vgl abs bzw z.b d.h tel hr fr u.u s.o s.u mme mlle mm m me env art p.ex p fol chap "
    "sr sra srta d dª núm aprox p.ej pág ud uds dra ks ns ts esim n nro tri "
    "см п рис т.е т.к напр стр ул им г гг тыс млн млрд рис гл डॉ रु सं श्री د أ".split()
)
# Those that may also end one:
EITHER = set(
    "inc ltd co corp llc a.m p.m etc al jr sr dept ft sq in lb oz kg km cm u.a usw evtl ggf "
    "ym yms jne oy oyj ee.uu руб коп т.д т.п др jan feb mar apr jun jul aug sep sept oct nov dec د.إ ه م".split()
)
# Words that report speech, by what stands after a quotation.
REPORT = set(
    "said asked wrote replied added answered cried shouted called says asks fragte sagte rief demanda dit répondit ajouta "
    "dijo preguntó respondió kysyi sanoi vastasi huusi спросил спросила сказал сказала ответил ответила "
    "कहा पूछा बोला बोली बताया سأل قال أجاب سألت قالت أجابت رد صاح".split()
)
ASKING = set("who what when where why how which is are was were do does did has have had can could will would should may".split())
STARTERS = set(
    "the this these that we i it he she they you there our my his her its their no if because since who what some most all every please nobody neither was is does".split()
)
GERMAN = set("der die das den dem des und ist kam am um im ein eine nach vor mit ohne über nicht wer weil seit vom zum".split())

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", "‘": "’", "{": "}"}
BRACKETS = set("([（【［{")
CLOSE = set("”“»›)]」』）】》〉］’\"'}")
WIDE = "。！？｡"
CLUSTER = re.compile("[.!?…‥。！？｡؟۔।॥։።။‼⁇⁈⁉]+")
NOSPACE = re.compile("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff฀-๿々〇]")
THAI = re.compile("[฀-๿]")
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
MARKER = re.compile(r"[ \t ]*(?:([•‣◦▪●○·*–—-])[ \t ]+|(\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})\)|\d{1,3}\.)[ \t ]+)\S")
SPACE = re.compile("[" + re.escape(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85") + "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")
QUOTE_END = re.compile(r"(?<=[,.!?…])['’](?=[\s,.;:)\]]|$)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
NAMED = re.compile(r"([A-Z][^\W\d_]*)! (?=[a-z]+\b)")
DOTTED = re.compile(r"\.(?=([\u00a0\u202f \t\r\n]+)(\S)|[,;:])")
MARKS = "\u0900-\u0903\u093a-\u094f"  # Devanagari vowel signs, which are no letters
BEFORE_STOP = re.compile(rf"(?<![\w.{MARKS}])((?:[^\W\d_]\.[\u00a0\u202f ]?)*(?:[^\W\d_][{MARKS}]*)+)$")
EDGE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　﻿"
REPORT_ZH = re.compile("^[^，。！？；：,;:]{0,30}[问問说說道答喊叫嚷写寫曰]")


def _abbreviation_key(word: str) -> str:
    """"Z. B" and "z.b" are one type."""
    return re.sub(r"[  ]", "", word).lower()


def _cased(block: str) -> bool:
    """Whether case says something: the block has both, or is too short to tell."""
    return (block.lower() != block) == (block.upper() != block)


def blocks(text: str) -> list[list[tuple[int, int]]]:
    """The lines of each block between blank lines, as places in the text."""
    if not LINE.search(text):
        return [[(0, len(text))]] if text.strip(EDGE) else []
    lines, at = [], 0
    for m in LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    out: list[list[tuple[int, int]]] = [[]]
    for s, e in lines:
        if text[s:e].strip(EDGE):
            out[-1].append((s, e))
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def _no_spaces(part: str) -> bool:
    letters = sum(c.isalpha() for c in part)
    return letters > 0 and 2 * len(NOSPACE.findall(part)) >= letters


def segments(text: str):
    """(start, end, is a list item) of every part that no sentence crosses."""
    for lines in blocks(text):
        out: list[list] = []
        item = False
        for k, (s, e) in enumerate(lines):
            m = MARKER.match(text, s, e)
            before = text[lines[k - 1][0] : lines[k - 1][1]].rstrip(EDGE) if k else ""
            if m and (k == 0 or item or before[-1:] in ":：" or (m[1] and m[1] not in "–—-" and before[-1:] in ".!?…")):
                out.append([s, e, True])
                item = True
                continue
            if k == 0:
                out.append([s, e, False])
            elif _no_spaces(text[lines[k - 1][0] : lines[k - 1][1]]) or _no_spaces(text[s:e]):
                out.append([s, e, False])
                item = False
            else:
                out[-1][1] = e
        yield from map(tuple, out)


#: All that can open or close a quotation or a bracket.
PAIRING = re.compile("[\"'" + re.escape("".join(OPEN) + ")]）】」』»”“’›》〉］}") + "]")


def _pairs(t: str) -> list[tuple[int, int, bool]]:
    """Quotations and brackets that close again: (open, close, is a bracket), outer ones first. One pass, whatever the nesting."""
    out, stack = [], []
    opened: dict[str, list[int]] = {}  # closing character -> places in the stack of what it closes, some of them gone
    ends: list[int] | None = None
    straight, quoted = -1, -1
    for found in PAIRING.finditer(t):
        i, c = found.start(), found[0]
        if c == '"':
            if straight >= 0:
                out.append((straight, i, False))
                straight = -1
            else:
                straight = i
        elif stack and c in stack[-1][1]:
            o, _ = stack.pop()
            out.append((o, i, t[o] in BRACKETS))
        elif c in OPEN and c != "‘":
            for x in OPEN[c]:
                opened.setdefault(x, []).append(len(stack))
            stack.append((i, OPEN[c]))
        elif c in ")]）】」』»”":  # an inner one never closed
            places = opened.get(c, [])
            while places and (places[-1] >= len(stack) or c not in stack[places[-1]][1]):
                places.pop()
            if places:
                o = stack[places[-1]][0]
                del stack[places.pop() :]
                out.append((o, i, t[o] in BRACKETS))
        elif c in "'‘" and (i == 0 or t[i - 1] in EDGE + "([“") and i + 1 < len(t) and t[i + 1].isalpha():
            if ends is None:
                ends = [m.start() for m in QUOTE_END.finditer(t)]
            k = bisect_right(ends, i)
            if k < len(ends) and quoted <= i:
                quoted = ends[k]
                out.append((i, quoted, False))
    return sorted(out)


def _dotted(block: str):
    """Each word (or letters with stops between them) before a full stop that white space or a comma follows, as a type, and the match of the stop."""
    for m in DOTTED.finditer(block):
        at = m.start()
        if not at or not (block[at - 1].isalpha() or "\u0900" <= block[at - 1] <= "\u094f"):
            continue
        space = block.rfind(" ", 0, at)
        if space > 0 and block[space - 1] != "." and (plain := block[space + 1 : at]).isalpha():
            yield plain.lower(), m
            continue
        back = 32
        while True:
            low = max(0, at - back)
            word = BEFORE_STOP.search(block[low:at])
            if not low or back > LONG or word and word.start() > 8:
                break
            back *= 4
        if word:
            yield _abbreviation_key(word[1]), m


class Evidence:
    """What the corpus says of word types; all sets are bounded by SHARE."""

    def __init__(self, short=(), common=(), named=()):
        self.short, self.common, self.named = set(short), set(common), set(named)


class Document:
    """What one document says of word types; each part is found when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def blocks(self) -> list[str]:
        """The blocks whose case says something."""
        found = (self.text[lines[0][0] : lines[-1][1]] for lines in blocks(self.text))
        return [b for b in found if _cased(b)]

    @cached_property
    def short(self) -> set[str]:
        """Abbreviations: types met before a stop after which the sentence goes on."""
        return {key for b in self.blocks for key, m in _dotted(b) if _goes_on(b, m)}

    @cached_property
    def common(self) -> set[str]:
        """Words met in lower case; a word that is not among them may be a proper name."""
        return {w for b in self.blocks for w in set(WORD.findall(b)) if w.islower()}

    @cached_property
    def named(self) -> set[str]:
        """Words whose ! ends nothing."""
        return {m[1].lower() for b in self.blocks if "! " in b for m in NAMED.finditer(b)}


def _camel(t: str, n: int) -> bool:
    """A word such as iPhone, whose first letter says nothing."""
    m = WORD.match(t, n)
    return bool(m) and any(c.isupper() for c in m[0][1:])


def _goes_on(block: str, m: re.Match) -> bool:
    """Whether the sentence goes on after a stop: a comma or a lower-case word follows, and no list item."""
    if m[2] is None:
        return True
    return m[2].islower() and not _camel(block, m.start(2)) and not (("\n" in m[1] or "\r" in m[1]) and MARKER.match(block, m.start(2)))


def _split(t: str, cased: bool, doc: Document, corpus: Evidence) -> list[tuple[int, int]]:
    pairs = _pairs(t)
    opens = [p[0] for p in pairs]
    thai = bool(THAI.search(t))
    danda = "।" in t
    edges = [-1, *(m.start() for m in SPACE.finditer(t))]  # before the first word, and every white space
    reach = list(accumulate((p[1] for p in pairs), max))  # how far any of the first ones reaches
    closing: dict[int, list[tuple[int, int, bool]]] = {}
    for p in pairs:
        closing.setdefault(p[1], []).append(p)
    out, start = [], 0
    language: list[bool] = []

    def german() -> bool:
        if not language:
            language.append(sum(w in GERMAN for w in WORD.findall(t.lower())) >= 2)
        return language[0]

    def common(word: str) -> bool:
        w = word.lower()
        return w in corpus.common or w in doc.common

    def first(s: int) -> int:
        while s < len(t) and t[s] in EDGE:
            s += 1
        return s

    def starts_anew(n: int) -> bool:
        """In text of one case: whether a sentence of some words may end before the word at n."""
        word = WORD.match(t, n)
        return bool(word) and word[0].lower() in STARTERS and len(WORD.findall(t[start:n])) >= 6

    def inside(i: int, k: int) -> bool:
        """Whether what is open at i closes at k or later."""
        n = bisect_left(opens, i)
        return n > 0 and reach[n - 1] >= k

    def full_stop(i: int, n: int, gap: bool) -> bool:
        """Of one stop at i before the character at n."""
        nxt = t[n]
        left = max(edges[bisect_right(edges, i - 1) - 1] + 1, i - LONG)
        token = t[left:i].lstrip("([{\"'“„«‘（¿¡-–—")
        if (m := NOSPACE.findall(token)) and token[-1:] != m[-1]:
            token = token[token.rindex(m[-1]) + 1 :]
        if not gap:
            if not nxt.isalnum():
                return nxt in OPEN and token[-1:].islower()
            if NOSPACE.match(nxt):
                return bool(NOSPACE.match(t[i - 1]))
            word = WORD.match(t, n)
            if word and len(word[0]) == 1 and cased and nxt.isupper() and re.match(r"\.\s", t[n + 1 : n + 3]) and len(token) > 2 and token.islower() and common(token):
                return True
            return bool(
                word and nxt.isupper() and cased and "." not in token and "@" not in token and "/" not in token and len(token) > 2 and (
                    t[i - 1].islower() or t[i - 1].isdigit() or t[i - 1] in CLOSE
                ) and len(word[0]) > 1 and not re.match(r"_|\.\w", t[n + len(word[0]) : n + len(word[0]) + 2])
            )
        if nxt in ",;:)]%":
            return False
        if thai and (THAI.match(nxt) or THAI.match(t[i - 1])):
            return False
        if danda and "ऀ" <= t[i - 1] <= "ॿ":
            return False
        if NOSPACE.match(nxt):
            return bool(NOSPACE.match(t[i - 1]))
        if cased and nxt.islower() and not _camel(t, n):
            return False
        word = WORD.match(t, n)
        after = word[0] if word else ""
        if not token:
            return True
        if len(after) == 1 and t[n + 1 : n + 2] == "." and len(token.rpartition(".")[2]) == 1 and token[-1].isalpha():
            return False  # a row of initials
        if token.isdigit():
            if re.match(r"\d{1,2}\.(\s|$)", t[n : n + 4]) or len(token) <= 2 and re.search(r"\d\.\s?$", t[max(0, left - 4) : left]):
                return False  # 2030. 5. 18.
            if len(token) <= 2 and german() and (nxt.isdigit() or (after and not common(after))):
                return False
            return not (len(token) <= 2 and nxt.isdigit() and re.match(r"\d{1,2}\. ?\d", t[n : n + 5]))
        key = re.sub(r"^[^\w]+", "", token).lower()
        if m := re.search(r"(?:^|[\s(])((?:[^\W\d_]\.[  ])+)$", t[max(0, left - 9) : left]):
            key = _abbreviation_key(m[1]) + key
        if m := re.search(r"(?:^|[\s(])([^\W\d_]{2})\. $", t[max(0, left - 5) : left]):
            key = f"{m[1].lower()}.{key}" if f"{m[1].lower()}.{key}" in EITHER else key
        last = key.rpartition(".")[2].lstrip("-")
        letters = token.replace(".", "").replace("-", "")
        if len(last) == 1 and last.isalpha():  # initials and dotted abbreviations
            if key in BEFORE:
                return False
            if not cased:
                return key in EITHER and starts_anew(n)
            if key in EITHER:
                return nxt.isupper() and bool(after) and (common(after) or not letters.isupper()) or nxt in OPEN
            if not any(c.islower() or c.isupper() for c in letters):
                return False
            return bool(after) and common(after) and not (
                len(letters) == 1 and letters.isupper() and not re.search(r"\d\s*$", t[max(0, left - 2) : left]) and not after.istitle()
            )
        if key in EITHER or last in EITHER and "." in key:
            if nxt.isdigit():
                return False
            if not cased:
                return starts_anew(n)
            return nxt in OPEN or nxt.isupper() and bool(after) and (common(after) or last not in ("jan", "feb", "sept", "uu"))
        if key == "no" and left == first(start):
            return not nxt.isdigit()
        known = key in doc.short and key not in corpus.common or key in corpus.short or key in BEFORE
        if not known or key in ("no", "min", "max", "in", "art") and cased and not nxt.isdigit() and token[:1].isupper():
            return True if not known else not (nxt.isdigit()) and (key not in BEFORE or common(after) or nxt in OPEN)
        if nxt.isdigit():
            return False
        if not cased:
            return key == "no" and not nxt.isdigit()
        return key not in BEFORE and (nxt in OPEN or common(after))

    def reported(n: int) -> bool:
        """Whether the words at n report the speech before them."""
        if NOSPACE.match(t[n]):
            return t[n] in "とって" or bool(REPORT_ZH.match(t[n : n + 40]))
        if t[n] in "，、":
            return True
        m = re.match(r"[^.!?…;:।؟]*", t[n : n + 120])
        words = [w.lower() for w in WORD.findall(m[0])][:6] if m else []
        words += [w.lower() for w in re.findall(r"[ऀ-ॿ]+", m[0])][-2:] if m else []
        return any(w in REPORT for w in words)

    def ends(i: int, j: int) -> int:
        """The end of the sentence that the terminators at [i, j) end, else -1."""
        mark = t[i:j]
        k, outer = j, None
        while k < len(t):
            p = k
            while p < len(t) and t[p] in "   " and p - k < 2:
                p += 1
            if p < len(t) and t[p] in CLOSE and (closed := [x for x in closing.get(p, ()) if x[0] < i]) and (p == k or t[p] in "»”"):
                outer, k = closed[0], p + 1
            elif p == k and t[k] in "\"”»’」』" and t[k] in CLOSE and not inside(i, i + 1) and (k + 1 == len(t) or t[k + 1] in EDGE):
                k += 1  # closes what opened in an earlier part
            else:
                break
        if inside(i, max(k, i + 1)):
            return -1
        n = first(k)
        if n >= len(t):
            return k
        nxt, gap = t[n], n > k
        if outer is not None:
            begin = first(start)
            if nxt in ",;:，、；：—–-…":
                return -1
            if CLUSTER.match(nxt) and not gap:
                return -1
            if outer[2]:
                if outer[0] > begin:
                    return -1
                return k if not (cased and nxt.islower()) or _camel(t, n) else -1
            if not gap and nxt in "“「『«‘" and any(c in "。？！?!" for c in mark):
                return -1 if outer[0] <= begin or t[outer[0] - 1] in "”」』" else k
            if not gap and nxt.isalpha() and not NOSPACE.match(nxt):
                return -1
            led = outer[0] > begin and t[begin : outer[0]].rstrip(EDGE)[-1:] in ":：,，、"
            chain = outer[0] > begin and t[begin] in OPEN
            if NOSPACE.match(nxt):
                if t[n] in "とっ" and not gap:
                    return -1
                if led:
                    return k
                return -1 if reported(n) or outer[0] > begin and not chain else k
            if cased and nxt.islower() and not _camel(t, n):
                return -1
            if not cased:
                if outer[0] <= begin:
                    return -1
                head = WORD.match(t, begin)
                return k if led or "." in mark or ("?" in mark and head and head[0].lower() in ASKING) else -1
            if not led and outer[0] <= begin and reported(n):
                return -1
            return k
        if mark[0] in "…‥" or mark.startswith("..."):
            if not re.search("[!?！？؟。]", mark):
                if not gap:
                    return -1
                word = WORD.match(t, n)
                if not cased:
                    return k if starts_anew(n) else -1
                return k if (word and nxt.isupper() and common(word[0])) or nxt in OPEN or nxt in "¿¡" or nxt.isdigit() else -1
        if mark == ".":
            return k if full_stop(i, n, gap) else -1
        if any(c in WIDE + "।॥؟።။" for c in mark):
            return k
        if not gap and (nxt.isalnum() and not NOSPACE.match(nxt) and not (nxt.isupper() and cased) or nxt in "/=&:_,;"):
            return -1
        if nxt in ",;:，、；：)":
            return -1
        if cased and nxt.islower() and not _camel(t, n):
            return -1
        if not cased and mark == "!":
            w = re.search(r"([^\W\d_]+)$", t[max(0, i - 30) : i])
            if w and (w[1].lower() in corpus.named or w[1].lower() in doc.named):
                return -1
        return k

    stops = [(m.start(), m.end(), False) for m in CLUSTER.finditer(t)]
    if thai:
        for m in re.finditer("[  ​\t]+", t):
            a, b = t[m.start() - 1 : m.start()], t[m.end() : m.end() + 1]
            if a and b and (THAI.match(a) or THAI.match(b)) and not any(x.isdigit() or x in ".ๆ" or ("A" <= x <= "Z" or "a" <= x <= "z" or "À" <= x <= "ɏ") for x in (a, b)):
                stops.append((m.start(), m.end(), True))
        stops.sort()
    for i, j, space in stops:
        if i < start:
            continue
        if space:
            if inside(i, i + 1):
                continue
            end = i
        else:
            end = ends(i, j)
        if end > start:
            out.append((start, end))
            start = end
    out.append((start, len(t)))
    return out


def split(text: str | None, corpus: Evidence | None = None) -> list[tuple[int, int]]:
    """The places of a text's sentences, in order, without white space at their edges."""
    if not text or not text.strip(EDGE):
        return []
    corpus, doc, out = corpus or Evidence(), Document(text), []
    for s, e, item in segments(text):
        t = text[s:e]
        for a, b in [(0, len(t))] if item else _split(t, _cased(t), doc, corpus):
            part = t[a:b]
            a += len(part) - len(part.lstrip(EDGE))
            b -= len(part) - len(part.rstrip(EDGE))
            if a < b:
                out.append((s + a, s + b))
    return out


def _count(batches):
    """Partial counts of word types: kind s before any stop, d before a stop after which the sentence goes on, g before a stop and a digit,
    c before a stop and a capital whose word the block also has in lower case, a (short types) in any form, l in lower case, n with a ! inside."""
    for batch in batches:
        counts: Counter = Counter()
        words: Counter = Counter()
        for text in batch.column("text").to_pylist():
            for lines in blocks(text or ""):
                block = text[lines[0][0] : lines[-1][1]]
                if not _cased(block):
                    continue
                found = Counter(WORD.findall(block))
                for key, m in _dotted(block):
                    counts["s", key] += 1
                    if m[2] and m[2].isupper() and (after := WORD.match(block, m.start(2))) and after[0].lower() in found:
                        counts["c", key] += 1
                    if _goes_on(block, m):
                        counts["d", key] += 1
                    elif m[2].isdigit():
                        counts["g", key] += 1
                words.update(found)
                if "! " in block:
                    counts.update(("n", m[1].lower()) for m in NAMED.finditer(block))
        for w, n in words.items():
            if w.islower():
                counts["l", w] = n
            if len(w) <= SHORT:
                counts["a", w.lower()] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                pa.array([counts[k] for k in keys], pa.int64())
            ], ["kind", "word", "n"]
        )


def abbreviations(by: dict[str, dict[str, int]]) -> set[str]:
    """The types that the corpus shows to be abbreviations: the sentence often goes on after their stop; or a number often follows it; or, being
    short, they hardly ever stand without a stop and what follows may be a name."""
    out = set()
    for w, stops in by["s"].items():
        on, number, lower, whole = by["d"].get(w, 0), by["g"].get(w, 0), by["l"].get(w, 0), by["a"].get(w, stops)
        if on >= 3 and 4 * on >= stops and 2 * stops >= lower:
            out.add(w)
        elif on + number >= 5 and 2 * (on + number) >= stops and 2 * stops >= lower:
            out.add(w)
        elif stops >= 20 and len(w) <= SHORT and w in by["a"] and 20 * stops >= 19 * whole and 20 * by["c"].get(w, 0) <= stops:
            out.add(w)
    return out


def corpus_evidence(documents: DataFrame) -> Evidence:
    """The counts of all documents, reduced to the types that hold at least 1/SHARE of their kind (so at most 7 SHARE rows)."""
    texts = documents.select("text").where(F.col("text").isNotNull())
    counts = written(texts.mapInArrow(_count, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")), "p9-counts")
    totals = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[x for k in "sdgclan" for x in (F.lit(k), F.lit(max(2, totals.get(k, 0) // SHARE)))])
    rows = counts.where(F.col("n") >= least[F.col("kind")]).collect()
    by: dict[str, dict[str, int]] = {k: {} for k in "sdgclan"}
    for r in rows:
        by[r.kind][r.word] = r.n
    return Evidence(abbreviations(by), by["l"], by["n"])


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: id_col, start_char, end_char (code points, from 0, end exclusive)."""
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(corpus_evidence(source))

    def cut(batches):
        corpus = shared.value
        for batch in batches:
            ids, starts, stops = [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for a, b in split(text, corpus):
                    ids.append(d)
                    starts.append(a)
                    stops.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], [id_col, "start_char", "end_char"]
            )

    return source.where(F.col("text").isNotNull()).mapInArrow(cut, f"{id_col} long, start_char long, end_char long")

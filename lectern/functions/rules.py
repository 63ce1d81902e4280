"""Many text rules at once: a trie with failure links finds in one scan which rules can apply at all.

Every rule has a needle, a string that any of its matches contains: what an
exact or word rule looks for, or the longest literal run that a pattern cannot
do without. Needles and texts are folded so that no spelling a case-insensitive
pattern accepts escapes. Rules whose needle a text lacks cannot match it; the
others, and patterns without needle, are tried in order. So the outcome is that
of all rules one after another, for the price of one scan of the text and of the
neighbourhood of what is put in.

Without patterns, no match reaches across a character that is not in what a rule
looks for (nor in a word, where rules heed words). The pieces between such
characters are then texts of their own, and what becomes of short ones is kept
for when they come again. Rules at the head that put a string for one character
go over the text as a whole before it is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import takewhile
from re import _constants as codes
from re import _parser as parser


def _folds() -> dict[int, str]:
    """One representative a character for all that match it regardless of case."""
    out = {}
    for k in range(0x110000):
        c = chr(k)
        f = c.casefold()
        f = f if len(f) == 1 else c.lower()
        if len(f) == 1 and f != c:
            out[k] = f
    # fixed values: pairs that patterns take for one letter although casefold does not
    return out | {0x130: "i", 0x131: "i", 0x1FD3: "\u0390", 0x1FE3: "\u03b0", 0xFB06: "\ufb05"}


_FOLDS: dict[int, str] = {}


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not _FOLDS:
        _FOLDS.update(_folds())
    return text.translate(_FOLDS)


def needle(pattern: str) -> str:
    """The longest run of letters that every match contains, folded; '' if none is known."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if tree.state.flags & re.VERBOSE:
        return ""
    runs = [""]

    def walk(items: Iterable) -> None:
        for kind, value in items:
            if kind is codes.LITERAL:
                runs[-1] += chr(value)
            elif kind is codes.SUBPATTERN:
                walk(value[3])
            elif kind is codes.MAX_REPEAT and value[0] >= 1:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif kind is not codes.AT:
                runs.append("")

    walk(tree)
    return max(map(folded, runs), key=len)


#: Pieces up to this length are kept with their outcome, twice as many as take up ``KEPT`` characters at most.
SHORT = 64
KEPT = 16_000_000
#: Pieces that a text is cut into at once.
MANY = 500_000


class RuleSet:
    """Rules in order as tuples (find, replace, match_type, case_sensitive); ``match_type`` is exact, word or regex.

    Rules that find nothing and patterns that do not compile are left out.
    Replacements may refer to groups as ``\\\\1``; all else in them is literal.
    """

    def __init__(self, rules: Iterable[tuple[str, str | None, str | None, bool | None]]) -> None:
        self.rules: list[tuple[str, int, list[str]]] = []
        needles: dict[str, list[int]] = {}
        self.always: list[int] = []
        #: For each rule that is one string for another: both, and whether no rule can find any of what it puts in.
        self.plain: list[tuple[str, str, bool] | None] = []
        letters, kinds = set(), set()
        for find, replace, kind, case in rules:
            if not find:
                continue
            pattern = find if kind == "regex" else re.escape(find)
            pattern = rf"\b{pattern}\b" if kind == "word" else pattern
            flags = 0 if case else re.IGNORECASE
            try:
                re.compile(pattern, flags)
            except (re.error, OverflowError, RecursionError):
                continue
            key = needle(find) if kind == "regex" else folded(find)
            (needles.setdefault(key, []) if key else self.always).append(len(self.rules))
            parts = re.split(r"\\(\d)", replace or "")
            self.rules.append((pattern, flags, parts))
            self.plain.append((find, parts[0], False) if case and kind not in ("regex", "word") and len(parts) == 1 else None)
            letters.update(find)
            kinds.add(kind)
        sought = set().union(*needles)
        self.plain = [x and (x[0], x[1], bool(x[1]) and sought.isdisjoint(folded(x[1]))) for x in self.plain]
        self.needles = needles
        self.reach = max(map(len, needles), default=1) - 1
        self.pieces = None
        if self.rules and "regex" not in kinds:
            word = r"\w" if "word" in kinds else ""
            self.pieces = re.compile(f"([{word}{''.join(map(re.escape, sorted(letters)))}]+)", re.IGNORECASE)
        self.head = list(takewhile(lambda x: x and len(x[0]) == 1, self.plain)) if self.pieces else []
        self._automaton = None
        self._compiled: dict[int, re.Pattern] = {}
        self._kept: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._room = KEPT

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_compiled": {}, "_kept": {}, "_older": {}, "_room": KEPT}

    def candidates(self, text: str, start: int = 0) -> list[int]:
        """Rules from ``start`` on that may match, in order."""
        found = set(self.always)
        if self.needles:
            if self._automaton is None:
                import ahocorasick

                self._automaton = ahocorasick.Automaton()
                for key, at in self.needles.items():
                    self._automaton.add_word(key, at)
                self._automaton.make_automaton()
            for _, at in self._automaton.iter(folded(text)):
                found.update(at)
        return sorted(k for k in found if k >= start)

    def pattern(self, k: int) -> re.Pattern:
        """Compiled when first needed."""
        if k not in self._compiled:
            self._compiled[k] = re.compile(*self.rules[k][:2])
        return self._compiled[k]

    def replaced(self, text: str | None) -> str | None:
        """The text after all rules, one after another."""
        if text is None:
            return None
        if self.pieces is None:
            return self._in_order(text)
        for find, new, _ in self.head:
            text = text.replace(find, new)
        out = []
        while text:
            *parts, text = self.pieces.split(text, MANY)
            parts[1::2] = map(self._piece, parts[1::2])
            if len(parts) < 2 * MANY:
                parts.append(text)
                text = ""
            out.append("".join(parts))
        return "".join(out)

    def _piece(self, text: str) -> str:
        """The outcome for one piece; what did not come again while others filled the room is dropped."""
        out = self._kept.get(text)
        if out is None:
            out = self._older.get(text)
            out = self._in_order(text) if out is None else out
            if len(text) <= SHORT:
                self._room -= len(text) + len(out) + 200
                if self._room < 0:
                    self._kept, self._older, self._room = {}, self._kept, KEPT
                self._kept[text] = out
        return out

    def _in_order(self, text: str) -> str:
        """The text after all rules behind the head."""
        left = self.candidates(text, len(self.head))[::-1]
        while left:
            k = left.pop()
            plain = self.plain[k]
            if plain and plain[0] not in text:
                continue
            if plain and (plain[2] or len(text) <= SHORT):
                text = text.replace(plain[0], plain[1])
                awakened = () if plain[2] else self.candidates(text, k + 1)
            else:
                text, spans = self._substituted(k, text)
                awakened = self._awakened(text, spans, k + 1) if spans else ()
            if awakened:
                left = sorted({*left, *awakened}, reverse=True)
        return text

    def _substituted(self, k: int, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The text after one rule, and where it put something in."""
        parts = self.rules[k][2]
        out, spans, done, size = [], [], 0, 0
        for m in self.pattern(k).finditer(text):
            new = "".join(p if i % 2 == 0 else (m.group(int(p)) or "" if int(p) <= m.re.groups else "") for i, p in enumerate(parts))
            size += m.start() - done
            out += [text[done : m.start()], new]
            spans.append((size, size + len(new)))
            size, done = size + len(new), m.end()
        return ("".join([*out, text[done:]]), spans) if spans else (text, spans)

    def _awakened(self, text: str, spans: list[tuple[int, int]], start: int) -> set[int]:
        """Rules from ``start`` on whose needle stands where something was put in; all others were known before."""
        merged: list[list[int]] = []
        for a, b in spans:
            a, b = max(0, a - self.reach), b + self.reach
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return {k for a, b in merged for k in self.candidates(text[a:b], start)}

    def matches(self, text: str) -> bool:
        """Whether any rule matches."""
        return any(self.pattern(k).search(text) for k in self.candidates(text))

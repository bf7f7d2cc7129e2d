"""Personal data with source offsets, also where it is disguised.

Plain identifiers (email, ip, card, phone) are found in the text as it stands.  Disguised ones are found in a
normalised copy: four transducers fold homoglyphs, bracketed and spoken at/dot disguises and spelled digits, each keeping the pieces
it replaced, so that a span of the normalised text leads back to the characters of the source.  Spans found that
way are added to the plain ones; a plain span is never changed.

Null text counts as empty and gives no span.  Every function is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Each at sign with the longest local part to its left and the longest host to its right."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
        free = host.end() if host else at
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def identifiers(text: str) -> dict[str, list[Span]]:
    """Plain spans by kind, leftmost and not overlapping within a kind."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if _is_ip(m[0])]
    found["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m[0])]
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# Letters of other scripts that look like a Latin one.
_LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXo"))
_INVISIBLE = frozenset("­​‌‍⁠﻿")


@lru_cache(maxsize=1 << 16)
def _fold(c: str) -> str | None:
    """What a look-alike stands for: one ASCII character, nothing for invisible ones, None for all others."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain != c and " " <= plain <= "~" else None


class Rewrite:
    """A text with replaced pieces, able to lead spans back to the text it was made from."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]):
        """pieces: (start, end, replacement), ascending and not overlapping."""
        out, at, size = [], 0, 0
        self.new, self.old = [], []  # spans of the replaced pieces after and before
        for start, end, by in pieces:
            out += (text[at:start], by)
            size += start - at
            self.new.append((size, size + len(by)))
            self.old.append((start, end))
            size += len(by)
            at = end
        out.append(text[at:])
        self.text = "".join(out)
        self._starts = [s for s, _ in self.new]

    def _source(self, at: int, end: bool) -> int:
        i = bisect_right(self._starts, at) - 1
        while i > 0 and self.new[i][0] == self.new[i][1] and at < self.new[i][1]:
            i -= 1
        if i < 0:
            return at + end
        (_, new_end), (old_start, old_end) = self.new[i], self.old[i]
        if at < new_end:
            return old_end if end else old_start
        return old_end + at - new_end + end

    def back(self, span: Span) -> Span:
        """The source span of all characters in ``span``."""
        return self._source(span[0], False), self._source(span[1] - 1, True)


def _fold_lookalikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    folds = {c: f for c in set(text) if not c.isascii() and (f := _fold(c)) is not None}
    if not folds:
        return []
    odd = re.compile("[" + "".join(map(re.escape, folds)) + "]")
    return [(m.start(), m.end(), folds[m[0]]) for m in odd.finditer(text)]


_BRACKETED = re.compile(r" *+[\[({<] *+(at|dot|@|\.) *+[\])}>] *+", re.I)
_LABEL = "[A-Za-z0-9-]++"
_SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++( at |@){_LABEL}(?:(?: dot |\.){_LABEL})*?( dot ){_LABEL}(?:(?: dot |\.){_LABEL})*", re.I)
_SPOKEN_IP = re.compile(r"(?<![0-9])[0-9]++(?:(?: dot |\.)[0-9]++){3}", re.I)
_DOT = re.compile(" dot ", re.I)


def _lower(text: str) -> str:
    """ASCII letters in lower case, all others as they are, so that the length stays."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _undo_bracketed(text: str) -> list[tuple[int, int, str]]:
    if not any(c in text for c in "[({<"):
        return []
    return [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(text)]


def _undo_spoken(text: str) -> list[tuple[int, int, str]]:
    """Spoken dots after a spoken or written at sign, and between the four numbers of an address."""
    if " dot " not in _lower(text):
        return []
    pieces = set()
    for m in _SPOKEN.finditer(text):
        if m[1] != "@":
            pieces.add((*m.span(1), "@"))
        pieces.update((*d.span(), ".") for d in _DOT.finditer(text, m.end(1), m.end()))
    for m in _SPOKEN_IP.finditer(text):
        pieces.update((*d.span(), ".") for d in _DOT.finditer(text, *m.span()))
    return sorted(pieces)


# English digit words.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ITEM = "(?:" + "|".join(_SPELLED) + "|[0-9]+)"
_NUMBER = rf"(?<![a-z0-9]){_ITEM}(?:[ -]+{_ITEM})*+"
_FOUR = re.compile(rf"{_NUMBER}(?:(?: dot |\.){_NUMBER}){{3}}(?![a-z0-9])")
_NAMED = re.compile(rf"((?<![a-z0-9._%+-])[a-z0-9._%+-]++ )?({_NUMBER})(?=@[a-z0-9-]++\.)")
_RUN = re.compile(rf"(?<![a-z0-9])(?:plus[ -]+)?{_ITEM}(?:(?:[ -]+|, ?){_ITEM})+(?![a-z0-9])")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_WORDY = re.compile("[a-z]{2}")
# Words before an address that are not part of its name.
_COMMON = frozenset("a an and are at by call contact email for from fax is mail me my of on or our phone reach reply send the to us via with write you your".split())


def _digits_of(words: str) -> str:
    return "".join("+" if t == "plus" else _SPELLED.get(t, t) for t in _TOKEN.findall(words))


def _undo_spelled(text: str) -> list[tuple[int, int, str]]:
    """Digit words, also mixed with digits: runs of nine digits or more, the four numbers of an address (with their
    dots), and those right before an at sign, together with the word before them, as part of an email's name."""
    low = _lower(text)
    if not any(w in low for w in _SPELLED):
        return []
    pieces = []
    for m in _RUN.finditer(low):
        digits = _digits_of(m[0])
        if len(digits) >= 9 and _WORDY.search(m[0]):
            pieces.append((m.start(), m.end(), digits))
    for m in _FOUR.finditer(low):
        if _WORDY.search(_DOT.sub(".", m[0])):
            pieces.append((m.start(), m.end(), ".".join(map(_digits_of, re.split(r" dot |\.", m[0])))))
    for m in _NAMED.finditer(low):
        if _WORDY.search(m[2]) and len(_digits_of(m[2])) < 9:
            before = (m[1] or "").rstrip(" ")
            start = m.start() if before and before not in _COMMON else m.start(2)
            pieces.append((start, m.end(2), (text[m.start(1) : m.end(1) - 1] if start < m.start(2) else "") + _digits_of(m[2])))
    apart, free = [], 0
    for piece in sorted(pieces, key=lambda x: (x[0], -x[1])):
        if piece[0] >= free:
            apart.append(piece)
            free = piece[1]
    return apart


TRANSDUCERS = (_fold_lookalikes, _undo_bracketed, _undo_spoken, _undo_spelled)


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows, by kind, none inside a plain span of its kind."""
    steps: list[Rewrite] = []
    current = text
    for transducer in TRANSDUCERS:
        pieces = transducer(current)
        if pieces:
            steps.append(Rewrite(current, pieces))
            current = steps[-1].text
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not steps:
        return out
    for kind, spans in identifiers(current).items():
        taken = sorted(plain[kind])
        starts = [s for s, _ in taken]
        free = 0
        for span in spans:
            for step in reversed(steps):
                span = step.back(span)
            i = bisect_right(starts, span[0]) - 1
            if span[0] >= free and (i < 0 or taken[i][1] < span[1]):
                out[kind].append(span)
                free = span[1]
    return out


def find_pii(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and added spans of a text, by kind, in code points."""
    text = text or ""
    plain = identifiers(text)
    return plain, disguised(text, plain)


def _told(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long"


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the plain spans, all spans, number of added ones.

    Other columns are ignored, whatever their names; null ids stay null; repeated rows give repeated rows.
    """

    def make():
        def run(rows: dict) -> dict:
            out = {n: [] for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised")}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                plain, added = find_pii(text)
                out["doc_id"].append(doc_id)
                for k in KINDS:
                    out[f"n_{k}"].append(len(plain[k]))
                out["base_sha256"].append(hashlib.sha256(_told(plain).encode()).hexdigest())
                out["spans"].append(_told({k: plain[k] + added[k] for k in KINDS}))
                out["n_disguised"].append(sum(map(len, added.values())))
            return out

        return run

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, SCHEMA)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; null stays null."""
    if not text:
        return text
    plain, added = find_pii(text)
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in plain[k] + added[k]):
        if end > at:
            out += (text[at:start] if start > at else "", f"[{kind.upper()}]" if start >= at else "")
            at = end
    return "".join(out) + text[at:]

"""Personal data: Aho-Corasick anchors, grown into spans by deterministic parsers.

One automaton finds every anchor of a text: at-signs, plus signs, schemes, and the words
that announce identifiers. A local parser grows each anchor to the boundaries of its
entity and validates it; digit runs serve as anchors of addresses and card numbers.
Every parser is linear in the text, whatever it holds.

Base kinds follow leftmost non-overlapping matching, each kind on its own:

* email: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip: four runs of digits joined by single dots, each at most 255
* card: digits, single blanks or hyphens between, 12 to 19 of them, passing Luhn
* phone: ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Further kinds come from cues: obfuscated emails ("name at host dot com"), user parts of
web addresses, accounts, and secrets behind words such as "iban", "ssn" or "token".

Defined results: a null text counts as an empty one, without spans; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import table

#: Order of kinds among spans that start together.
KINDS = ("email", "ip", "card", "phone", "email_words", "url_user", "account", "secret")
#: Cue words by the parser that they start; matched without case.
CUES = {
    "secret": ("token", "api_key", "apikey", "api key", "secret"),
    "password": ("password", "passwd"),
    "account": ("iban", "ssn", "passport", "account", "acct"),
    "words": (" at ", "(at)", "[at]"),
    "scheme": ("://",),
    "at": ("@",),
    "plus": ("+",),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_AFTER_AT = re.compile(r"\s?([A-Za-z0-9-]{1,63}(?:\s?(?: dot |\(dot\)|\[dot\])\s?[A-Za-z0-9-]{2,63}){1,5})(?![A-Za-z0-9])")
_USER = re.compile(r"[^\s/@:]++(?::[^\s/@]++)?@")
_SECRET = re.compile(r"""\s{0,4}[:=]\s{0,4}["']?([A-Za-z0-9_\-+/.]{16,}+)""")
_PASSWORD = re.compile(r"""\s{0,4}[:=]\s{0,4}["']?([A-Za-z0-9_\-+/.!@#$%^&*?~]{4,}+)""")
_ACCOUNT = re.compile(r"(?:\s{0,4}(?:number|no\.?|#))?\s{0,4}[:=#]?\s{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]?[0-9]{6,18})(?![A-Za-z0-9])")
_LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    """Whether the digits carry a valid check digit."""
    n = [int(x) for x in reversed(digits)]
    return (sum(n[::2]) + sum(_LUHN[x] for x in n[1::2])) % 10 == 0


def automaton() -> ahocorasick.Automaton:
    """The anchors; the value of each is its parser and its length."""
    out = ahocorasick.Automaton()
    for kind, cues in CUES.items():
        for cue in cues:
            out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


def ascii_lower(text: str) -> str:
    """A-Z in lower case; every code point keeps its place."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}
_DIGIT = re.compile(r"[0-9]")


def iban(text: str) -> bool:
    """Whether an account number of letters and digits passes modulo 97."""
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def base_spans(text: str, anchors: dict[str, list[int]]) -> list[tuple[int, int, str]]:
    """Spans of the four base kinds: (start, end, kind)."""
    out, done = [], 0
    for at in anchors.get("at", ()):
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
    done = 0
    for at in anchors.get("plus", ()):
        if at >= done and (m := _PHONE.match(text, at + 1)):
            done = m.end()
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((at, m.end(), "phone"))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if 12 <= len(m[0]) <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
    return out


def cue_spans(text: str, anchors: dict[str, list[int]]) -> list[tuple[int, int, str]]:
    """Spans that cues announce; none of them lies on an earlier one of its kind."""
    out = []
    for end in anchors.get("words", ()):
        start = end - 4
        before, after = _BEFORE_AT.search(text, max(0, start - 64), start if text[start - 1 : start] != " " else start - 1), _AFTER_AT.match(text, end)
        if before and after:
            out.append((before.start(), after.end(), "email_words"))
    for end in anchors.get("scheme", ()):
        if m := _USER.match(text, end):
            out.append((end, m.end() - 1, "url_user"))
    for end in anchors.get("account", ()):
        if m := _ACCOUNT.match(text, end):
            if not m[1][:2].isalpha() or iban(m[1]):
                out.append((*m.span(1), "account"))
    for end in anchors.get("secret", ()):
        if m := _SECRET.match(text, end):
            out.append((*m.span(1), "secret"))
    done = 0
    for end in anchors.get("password", ()):
        if end >= done and (m := _PASSWORD.match(text, end)):
            out.append((*m.span(1), "secret"))
            done = m.end()
    kept, last = [], {}
    for span in sorted(out):
        if span[0] >= last.get(span[2], 0):
            kept.append(span)
            last[span[2]] = span[1]
    return kept


def find(text: str | None, cues: ahocorasick.Automaton) -> tuple[list, list]:
    """Base spans and all spans of a whole text, in order of start, then kind."""
    text = text or ""
    anchors: dict[str, list[int]] = {}
    for end, (kind, size) in cues.iter(ascii_lower(text)):
        anchors.setdefault(kind, []).append(end if size == 1 else end + 1)
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text, anchors), key=order)
    return base, sorted(base + cue_spans(text, anchors), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def spans_of(docs: DataFrame, column: str = "pii") -> DataFrame:
    """``docs`` with struct ``column``: counts of base kinds, digest of base spans, all spans, and counts of the further kinds and of all spans.

    An input column of that name is replaced.
    """
    names = [*(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[4:]), "n_spans"]
    types = {"base_sha256": "string", "spans": "string"}

    @F.pandas_udf(", ".join(f"{n} {types.get(n, 'long')}" for n in names))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cues = automaton()
        for b in batches:
            rows = []
            for text in b:
                base, every = find(text, cues)
                kinds, more = [k for _, _, k in base], [k for _, _, k in every]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*map(kinds.count, KINDS[:4]), digest, joined(every), *map(more.count, KINDS[4:]), len(every)))
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn(column, of.asNondeterministic()(F.col("text")))


def op6_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; see the module for nulls."""
    return spans_of(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "pii.*")

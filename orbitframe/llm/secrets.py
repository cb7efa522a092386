"""Secret scanning: keyword automaton, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, prepare

# The patterns of the base kinds and their least lengths.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 24

# Public token formats whose last six characters are a base-62 CRC-32 of what stands before them.
CHECKED_PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEY_BLOCK = re.compile(r"-----BEGIN (?P<kind>[A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END (?P=kind)-----")
KINDS = ("assign", "access", "hex", "github", "npm", "key")

_HEX_DIGITS = "0123456789abcdef"
_AUTOMATON = None


def automaton():
    """Keywords over ASCII-lowered text: the literal starts of all kinds, and every run of four hex digits, of which a
    run of 24 must hold some."""
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for w in ASSIGN_WORDS:
            a.add_word(w, ("assign", len(w)))
        a.add_word("akia", ("access", 4))
        for kind, starts in CHECKED_PREFIXES.items():
            for p in starts:
                a.add_word(p, (kind, len(p)))
        a.add_word("-----begin ", ("key", 11))
        for x in _HEX_DIGITS:
            for y in _HEX_DIGITS:
                for z in _HEX_DIGITS:
                    for w in _HEX_DIGITS:
                        a.add_word(x + y + z + w, ("hex", 4))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def base62_crc(payload: str) -> str:
    value, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def find_secrets(text: str | None) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of every secret, code points, by start and then as KINDS lists them.

    Matches of one kind don't overlap and the leftmost wins, also against one that is dropped for its length."""
    if not text:
        return []
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    over = dict.fromkeys(KINDS, 0)
    found = []
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton().iter(lowered))
    for start, kind in hits:
        if start < over[kind]:
            continue
        if kind == "hex":
            begin = start
            while begin > over["hex"] and text[begin - 1] in _HEX_DIGITS:
                begin -= 1
            m = HEX.match(text, begin)
            if m and m.end() > start:
                over[kind] = m.end()
                if m.end() - m.start() >= HEX_LEAST:
                    found.append((m.start(), kind, m.end()))
        elif kind == "assign":
            if m := ASSIGN.match(text, start):
                over[kind] = m.end()
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    found.append((m.start(), kind, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                over[kind] = m.end()
                if m.end() - m.start() >= ACCESS_LEAST:
                    found.append((m.start(), kind, m.end()))
        elif kind == "key":
            if m := KEY_BLOCK.match(text, start):
                over[kind] = m.end()
                found.append((m.start(), kind, m.end()))
        elif text[start : start + 4] in CHECKED_PREFIXES[kind] and (m := CHECKED.match(text, start + 4)):
            body = m.group()
            if base62_crc(body[:-6]) == body[-6:]:
                over[kind] = m.end()
                found.append((start, kind, m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


SPANS = "array<struct<start:int,kind:string,end:int>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)`` for every row; ``spans`` is empty for a null or empty text."""
    prepare(docs.sparkSession)

    def run(batches):
        for frame in batches:
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in find_secrets(t)] for t in frame["text"]]
            yield frame[["doc_id", "no_id"]].assign(spans=spans)

    return map_texts(docs, run, f"spans {SPANS}", id_col, text_col)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mark``; overlapping spans are replaced as one."""
    prepare(docs.sparkSession)
    names = docs.columns

    def clean(text):
        spans = find_secrets(text)
        if not spans:
            return text
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def scrub(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean(t) if isinstance(t, str) else None)

    return docs.withColumn(text_col, scrub(F.col(text_col))).select(*names)

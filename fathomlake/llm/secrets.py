"""A scan for secrets by token efficiency.

Random strings compress badly under a tokenizer's vocabulary: a word or a path
has many characters per token, a key few. Candidates are all runs of key
characters in a text and their pieces; those that are known digests or
identifiers are left out; what remains with a low ratio of characters to tokens
is reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .tokencount import PATTERN, RANKS, load_ranks

#: Characters of a secret at least; of one that is cut by ``_`` or ``-``; of a plain word; the ratio that plain words must stay below unless a credential's name introduces them.
LEAST, LEAST_CUT, LEAST_WORD, WORD_RATIO = 12, 16, 15, 2.0
_KEY = r"A-Za-z0-9_+/=.\-!@#$%^&*~"
#: A run of key characters, which is cut into candidates.
CANDIDATE = rf"[{_KEY}]{{{LEAST},}}"
_EDGE = "!@#$%^&*~.-"
_PIECE, _PART = regex.compile(r"[^=/.]+"), regex.compile(r"[^_\-!@#$%^&*~]+")
_WORD = regex.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
_ACCENTED = regex.compile(r"(?V1)[\p{Latin}--[a-zA-Z]]")
_BASE64 = regex.compile(r"[A-Za-z0-9+/]+(?:={1,2}(?![A-Za-z0-9_+/=.\-]))?")
_UUID = regex.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_DIGEST = regex.compile(r"(?i)(?:(?:md5|sha\d{0,3}|blake\w{0,4})[\-_])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})")
_INTEGRITY = regex.compile(r"(?i)sha(?:256-[a-z0-9+/]{43}=?|384-[a-z0-9+/]{64}|512-[a-z0-9+/]{86}(?:==)?)(?![a-z0-9+/])")
_CREDENTIAL = regex.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer|credential)[\w\-]{0,20}[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$")
_EMAIL = regex.compile(r"(?<![:\w.+\-])[\w.+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}", regex.ASCII)
_PLAIN, _ESCAPED = regex.compile(r"[\d.+\-/=_]+"), regex.compile(r"%[0-9A-Fa-f]{2}")
#: A date or an address before something else.
_DATED = regex.compile(r"(?:\d{1,4}[.\-/_]){2,}(?:\d{1,2}T)?")


def is_known(candidate: str, before: str) -> bool:
    """Whether a candidate is a number, a date, escaped text, a UUID or a digest, with the name of its hash or without.

    A string of a digest's form that a credential's name introduces is not taken for a digest.
    """
    core = candidate.strip(".-=/_+")
    if _PLAIN.fullmatch(core) or _UUID.fullmatch(core) or "%" in core and len(_ESCAPED.sub("", core)) < LEAST:
        return True
    return bool(_DIGEST.fullmatch(core)) and not _CREDENTIAL.search(before)


def limit_of(candidate: str, before: str, least_ratio: float) -> float:
    """The ratio that a candidate must stay below; 0 if it is too short to tell.

    Up to 14 lower-case letters, and words joined by signs of fewer than 16 characters, have the ratio
    of random strings too often; so have longer words between 2.0 and 2.2, unless a credential's name introduces them.
    """
    if _WORD.fullmatch(candidate):
        named = len(candidate) >= LEAST_CUT and _CREDENTIAL.search(before)
        return 0 if len(candidate) < LEAST_WORD else least_ratio if named else min(WORD_RATIO, least_ratio)
    return 0 if len(candidate) < (LEAST_CUT if "_" in candidate or "-" in candidate else LEAST) else least_ratio


def secrets(text: str, begin: int, end: int, ratio: Callable[[str], float], least_ratio: float, skip: frozenset[str] = frozenset()) -> Iterator[tuple[int, int]]:
    """Begin and end of each secret in a run of key characters.

    A name, a path, a date or a sentence's end must not be weighed with the secret beside
    it: a run is scored in pieces between ``=``, ``/`` and ``.``, and where a piece
    is none, in parts between other signs. As base64 has ``/`` and ``=`` itself, a
    run of it counts as a whole if no piece of it is like words or known.
    """

    def known(i: int, j: int) -> bool:
        return text[i:j].lower() in skip or is_known(text[i:j], text[max(0, i - 48) : i])

    def secret(i: int, j: int) -> bool:
        # A word with an accented letter is no run of key characters by itself.
        if i and _ACCENTED.match(text[i - 1]) or j < len(text) and _ACCENTED.match(text[j]):
            return False
        limit = limit_of(text[i:j], text[max(0, i - 48) : i], least_ratio)
        return limit > 0 and not known(i, j) and ratio(text[i:j]) < limit

    end = begin + len(text[begin:end].rstrip(_EDGE))
    if _WORD.fullmatch(text, begin, end) and end - begin < LEAST_WORD or text[begin:end].lower() in skip:
        return
    taken = [m.span() for m in _INTEGRITY.finditer(text, begin, end) if not _CREDENTIAL.search(text[max(0, m.start() - 48) : m.start()])]
    taken += [m.span() for m in _EMAIL.finditer(text, begin, end)]
    free = lambda i, j: all(j <= a or i >= b for a, b in taken)
    for m in _BASE64.finditer(text, begin, end):
        if not regex.search(r"[/=]", m.group()) or not free(*m.span()) or m.end() - m.start() < LEAST_CUT or not secret(*m.span()):
            continue
        pieces = [p.span() for p in _PIECE.finditer(text, *m.span())]
        if not any(j - i >= LEAST_CUT and known(i, j) or j - i >= 4 and ratio(text[i:j]) >= least_ratio for i, j in pieces):
            taken.append(m.span())
            yield m.span()
    for m in _PIECE.finditer(text, begin, end):
        i, j = m.start(), m.start() + len(m.group().rstrip(_EDGE))
        i = j - len(text[i:j].lstrip(_EDGE))
        if dated := _DATED.match(text, i, j):
            i = dated.end()
        if j - i < LEAST or not free(i, j) or text[i:j].lower() in skip:
            continue
        if secret(i, j):
            yield i, j
        else:
            yield from (p.span() for p in _PART.finditer(text, i, j) if p.end() - p.start() < j - i and secret(*p.span()))


SCHEMA = StructType([StructField(n, t()) for n, t in (("doc_id", LongType), ("position", LongType), ("n_chars", LongType), ("n_tokens", LongType), ("ratio", DoubleType), ("masked", StringType))])


def scan(docs: DataFrame, ranks_path: str = RANKS, least_ratio: float = 2.2, known: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, position, n_chars, n_tokens, ratio, masked)``, one row for each secret found.

    ``position`` counts characters from 0. ``masked`` shows four characters, never
    the secret. ``known`` lists digests or identifiers to leave out, whatever
    their case. Null and empty texts have no secrets; a null id stays null; repeated rows report theirs
    each; an empty table gives no row. Texts without a run of key characters never leave the JVM.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    skip = frozenset(k.lower() for k in known)
    arrow = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        find = regex.compile(CANDIDATE).finditer
        for b in batches:
            at, rows = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                for m in find(text):  # a word that is too short to tell, by far the most frequent run, costs one match
                    for i, j in sorted(secrets(text, *m.span(), lambda s: len(s) / len(enc.encode_ordinary(s)), least_ratio, skip)):
                        n = len(enc.encode_ordinary(text[i:j]))
                        at.append(row)
                        rows.append((i, j - i, n, (j - i) / n, text[i : i + 4] + "*" * 8))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])] if rows else [pa.array([], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.filter(F.col("text").rlike(CANDIDATE)).mapInArrow(run, SCHEMA)

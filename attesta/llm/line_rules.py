"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much are rejected.

A word is a run without ASCII white space. Lines are split at ``\\n`` and judged
without the ASCII white space around them; a line without a word is dropped and
counts as no loss. A line fails if it

* ``punctuation``: doesn't end in a terminal mark (closing quotes and brackets may follow);
* ``navigation``: has three or more of the bars that separate menu entries;
* ``boilerplate``: holds one of the phrases below, in any case;
* ``symbols``: consists of symbols by more than a tenth.

A document is kept if it passes the base rules and at most LOSS % of the
characters of its lines went. Null and empty text: no words, so the base rules
fail. Null doc_id and repeated rows: judged like any other row. Extra columns
are ignored. One map over whole texts: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terminal marks, closers, menu bars, symbols, boilerplate phrases.
TERMINAL = ".!?…。！？"
CLOSERS = "\"')]”’»"
BARS = "|•·»›"
SYMBOLS = "#*$%&|<>"
PHRASES = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
    "subscribe to our newsletter", "click here", "sign up for", "log in to", "follow us on", "share this", "read more", "lorem ipsum",
    "tous droits réservés", "alle rechte vorbehalten", "todos los derechos reservados",
)
LEAST_WORDS, MOST_REPEATED, LOSS = 50, 50, 40
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_failed_lines long, chars long, chars_lost long"
)
WHITE = " \t\n\x0b\x0c\r"
_ENDS = re.compile(f"[{re.escape(TERMINAL)}][{re.escape(CLOSERS)}]*$")
_BAR, _SYMBOL = re.compile(f"[{re.escape(BARS)}]"), re.compile(f"[{re.escape(SYMBOLS)}]")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)))


def failing(line: str) -> str | None:
    """The first rule that a stripped line fails."""
    if not _ENDS.search(line[-8:]) and not _ENDS.search(line):
        return "punctuation"
    if len(_BAR.findall(line)) >= 3:
        return "navigation"
    if _PHRASE.search(line.lower()):
        return "boilerplate"
    if 10 * len(_SYMBOL.findall(line)) > len(line):
        return "symbols"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    keys = (ids[:-2] * len(number) + ids[1:-1]) * len(number) + ids[2:]  # exact below 2^21 different words
    if len(number) >= 1 << 21:
        pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1].astype(np.int64)
        keys = pairs * len(number) + ids[2:]
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def judge(text: str | None) -> tuple[tuple, str]:
    """The figures of one text (SCHEMA without doc_id) and its cleaned text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    joined = b"".join(words)
    word_chars = len(joined) if joined.isascii() else len(joined.decode())
    seen: set[str] = set()
    dup = lines = failed = chars = lost = 0
    keep = []
    for line in text.split("\n"):
        bare = line.strip(WHITE)
        if not bare:
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        chars += len(bare)
        if failing(bare):
            failed += 1
            lost += len(bare)
        else:
            keep.append(bare)
    repeated = repeat_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    kept = not base_failed and 100 * lost <= LOSS * chars
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    return (len(words), word_chars, symbols, dup, repeated, base_failed, kept, lines, failed, chars, lost), "\n".join(keep)


def clean(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: the figures, the verdict and, if asked for, the cleaned text."""
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [judge(text.as_py()) for text in part.column(1)]
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*(r for r, _ in rows), strict=True), types, strict=True))]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_text:
                    columns, names = [*columns, pa.array([t for _, t in rows], pa.string())], [*names, "clean_text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + (", clean_text string" if with_text else ""))

"""Quality rules, line first: clean the lines, then reject documents that lost too much text.

Each line with a word is held against three rules. Punctuation: it must end a sentence, and marks
must not make up a fifth of it. Navigation: two or more words that are separators. Boilerplate: a
phrase of licences, cookies, menus or scripts. Lines that fail are removed. A document is kept if it
passes the base rules (ten words, at most a fifth of the words in repeated windows) and its lines that
stay hold at least half of its text.

Defined results: null or empty text has no words and is not kept; texts are read whole; repeated rows
have equal results; other columns stay, but those with the names of results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, append, text_of

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("lines_removed", T.LongType()),
    T.StructField("chars_removed", T.LongType()),
    T.StructField("clean_text", T.StringType()),
]

SYMBOLS = "#*$%&|<>"
#: Regular expressions that both Python and SQL read alike, for one line.
ENDS_SENTENCE = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
MARKS = r"""[!-&(-/:-@\[-`{-~]"""
SEPARATOR = r"^[|»›>·•–—-]$"
BOILERPLATE = (
    r"cookie|privacy policy|terms of (use|service)|all rights reserved|licen[sc]ed? under|released under|"
    r"copyright (©|\(c\))|sign (in|up)|log ?in|subscribe|javascript|lorem ipsum|click here|read more|share this|back to top"
)
#: Percentages: marks of a line, text that a document may lose.
MOST_MARKS, MOST_LOST = 20, 50
WINDOW = 5

_word, _ends, _marks = re.compile(WORD), re.compile(ENDS_SENTENCE), re.compile(MARKS)
_separator, _boilerplate = re.compile(SEPARATOR), re.compile(BOILERPLATE)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in windows which occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n < 64:
        windows = [tuple(words[i : i + window]) for i in range(n)]
        seen = Counter(windows)
        hit = np.array([seen[w] > 1 for w in windows])
    else:
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        code, base = ids[:n], len(known)
        for i in range(1, window):
            if int(code.max()) + 1 > (1 << 62) // base:  # exact: number the prefixes anew before they overflow
                code = np.unique(code, return_inverse=True)[1].reshape(-1)
            code = code * base + ids[i : i + n]
        _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
        if len(counts) == n:
            return 0
        hit = counts[at.reshape(-1)] > 1
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def line_fails(line: str, words: list[str], chars: int) -> bool:
    if not _ends.search(line):
        return True
    if 100 * len(_marks.findall(line)) > MOST_MARKS * chars:
        return True
    if sum(1 for w in words if len(w) == 1 and _separator.match(w)) >= 2:
        return True
    return bool(_boilerplate.search(line.lower()))


def measure(text: str) -> tuple:
    words = _word.findall(text)
    word_chars = sum(map(len, words))
    seen: set[str] = set()
    dup = lost = gone = 0
    kept_lines = []
    for line in text.split("\n"):
        in_line = _word.findall(line)
        if not in_line:
            kept_lines.append(line)
            continue
        dup += line in seen
        seen.add(line)
        chars = sum(map(len, in_line))
        if line_fails(line, in_line, chars):
            gone += 1
            lost += chars
        else:
            kept_lines.append(line)
    repeats = repeated_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    kept = not failed and 100 * lost <= MOST_LOST * word_chars
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), word_chars, symbols, dup, repeats, failed, kept, gone, lost, "\n".join(kept_lines)


def _columns(text: pa.Array) -> list[pa.Array]:
    rows = [measure(t) for t in text_of(text)]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with the base measures, the verdict and the text without the failed lines."""
    return append(docs, ["text"], FIELDS, _columns)


def oracle() -> str:
    """DuckDB SQL for the query's rows."""
    word = WORD.replace("'", "''")
    ends, marks, boiler, sep = (x.replace("'", "''") for x in (ENDS_SENTENCE, MARKS, BOILERPLATE, SEPARATOR))
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in SYMBOLS)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{word}') as ws from d),
m as (
  select r, doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
         {symbols} as n_symbols
  from w
),
lines as (
  select r, line, regexp_extract_all(line, '{word}') as ws, row_number() over (partition by r, line) as k
  from (select r, unnest(string_split(t, chr(10))) as line from d)
),
judged as (
  select r, k, list_sum(list_transform(ws, lambda x: length(x))) as chars,
         not regexp_matches(line, '{ends}')
         or 100 * len(regexp_extract_all(line, '{marks}')) > {MOST_MARKS} * list_sum(list_transform(ws, lambda x: length(x)))
         or len(list_filter(ws, lambda x: regexp_matches(x, '{sep}'))) >= 2
         or regexp_matches(lower(line), '{boiler}') as bad
  from lines where len(ws) > 0
),
by_doc as (
  select r, count(*) filter (where k > 1) as n_dup_lines, count(*) filter (where bad) as lines_removed,
         coalesce(sum(chars) filter (where bad), 0) as chars_removed
  from judged group by r
),
windows as (
  select r, i, list_slice(ws, i, i + {WINDOW - 1}) as g
  from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from w where len(ws) >= {WINDOW})
),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as n from windows) where n > 1),
repeats as (select r, count(distinct i + j) as n from again, range(0, {WINDOW}) x(j) group by r),
a as (
  select m.*, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words,
         coalesce(lines_removed, 0) as lines_removed, coalesce(chars_removed, 0) as chars_removed
  from m left join by_doc using (r) left join repeats using (r)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * chars_removed <= {MOST_LOST} * word_chars as kept,
       lines_removed::bigint as lines_removed, chars_removed::bigint as chars_removed
from a
"""

"""Line-first cleaning: lines are judged one by one, then the document by what is left."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_batches, table, texts_of

MOST_LOST = 0.5
TERMINAL = ".!?…\"'’”»):;,。！？"
NAVIGATION = ("about", "account", "back", "basket", "blog", "cart", "categories", "contact", "faq", "forum", "help", "home",
              "login", "logout", "menu", "more", "next", "previous", "register", "search", "share", "sitemap", "top")
BOILERPLATE = ("accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
               "powered by", "privacy policy", "read more", "sign up for", "skip to content", "subscribe to", "terms of service",
               "terms of use", "use of cookies", "we use cookies")

# White space that str.split() takes and the words' definition doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SEPARATORS = ("|", "»", "›", ">", "·", "•")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))
_MARKED = re.compile(r"[#*$%&<>{}]|!!")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words inside a 3-word window that occurs twice or more in ``words``."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * np.int64(len(number)) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[window] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def line_fault(line: str, words: list[str]) -> str | None:
    """Name of the first rule that the line fails, or None.

    ``navigation``: three or more items between separators, or nothing but menu
    words. ``boilerplate``: one of the stock phrases. ``marked``: over a third of
    the words carry symbols or double exclamation marks. ``open``: five words or
    more, none of which ends with a closing sign.
    """
    if sum(w in _SEPARATORS for w in words) >= 2:
        return "navigation"
    lowered = line.lower()
    if all(w.strip("|>:.,") in NAVIGATION for w in words_of(lowered) if w not in _SEPARATORS):
        return "navigation"
    if _BOILER.search(lowered):
        return "boilerplate"
    if _MARKED.search(line) and 3 * sum(_MARKED.search(w) is not None for w in words) > len(words):
        return "marked"
    if len(words) >= 5 and not any(w[-1] in TERMINAL for w in words):
        return "open"
    return None


def clean(text: str) -> tuple[str, int]:
    """The text without its faulty lines, and the words that went with them. Lines without words stay."""
    kept, lost = [], 0
    for line in text.split("\n"):
        words = words_of(line)
        if words and line_fault(line, words):
            lost += len(words)
        else:
            kept.append(line)
    return "\n".join(kept), lost


def _digest(text: str) -> tuple:
    words = words_of(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    cleaned, lost = clean(text)
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)),
            repeated_words(words), lost, cleaned)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long"


def clean_lines(docs: DataFrame, most_lost: float = MOST_LOST, with_text: bool = True) -> DataFrame:
    """``doc_id``, the counts, ``base_failed, kept`` and the ``cleaned`` text of every row of ``docs``.

    Every line of the whole text is judged (``line_fault``) and faulty lines go;
    a document is kept if it passes the base limits (50 words, half of the words
    in repeated 3-word windows) and loses at most ``most_lost`` of its words.
    One pass, nothing is shuffled; memory holds one Arrow batch. Null or empty
    text: all counts 0, ``base_failed``, not kept, empty ``cleaned``. Repeated
    rows and null ids are judged like others; other columns are not read; an
    empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*map(_digest, texts_of(batch)))) or [()] * 7
        arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string())] * with_text
        names = [c.split()[0] for c in COUNTS.split(", ")] + ["cleaned"] * with_text
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    counted = map_batches(docs.select("doc_id", "text"), work,
                          f"doc_id {kind}, {COUNTS}" + ", cleaned string" * with_text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_lost_words") <= most_lost * F.col("n_words")))


def op4_line_rules(spark, folder: str) -> DataFrame:
    return clean_lines(table(spark, folder, "documents"), with_text=False)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
x as (select rid, unnest(string_split(text, chr(10))) as line from d),
l as (select *, lower(line) as low from (select rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w from x) where len(w) > 0),
f as (select rid, line, len(w) as n,
    len(list_filter(w, lambda y: list_contains({_list(_SEPARATORS)}, y))) >= 2
    or len(list_filter(regexp_extract_all(low, '[^\x20\x09-\x0D]+'), lambda y: not list_contains({_list(_SEPARATORS)}, y)
         and not list_contains({_list(NAVIGATION)}, trim(y, '|>:.,')))) = 0
    or regexp_matches(low, '{"|".join(BOILERPLATE)}')
    or 3 * len(list_filter(w, lambda y: regexp_matches(y, '[#*$%&<>{{}}]|!!'))) > len(w)
    or (len(w) >= 5 and len(list_filter(w, lambda y: contains({_list([TERMINAL])}[1], right(y, 1)))) = 0) as fault from l),
n as (select rid, sum(n)::bigint as n_words, coalesce(sum(n) filter (where fault), 0)::bigint as n_lost_words,
    (count(*) - count(distinct line))::bigint as n_dup_lines from f group by rid),
t as (select rid, unnest(w) as word, generate_subscripts(w, 1) as i from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d)),
g as (select rid, i, word, lead(word) over o as b, lead(word, 2) over o as c from t window o as (partition by rid order by i)),
h as (select rid, i, word, (c is not null and count(*) over (partition by rid, word, b, c) > 1)::int as again from g),
r as (select rid, length(word) as chars, max(again) over (partition by rid order by i rows between 2 preceding and current row) as covered from h),
k as (select rid, sum(chars)::bigint as word_chars, sum(covered)::bigint as n_repeat_words from r group by rid),
a as (select d.rid, doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lost_words, 0) as n_lost_words
  from d left join n using (rid) left join k using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * n_lost_words <= n_words as kept from a
"""

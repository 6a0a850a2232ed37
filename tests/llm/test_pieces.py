"""Repeated passages inside longer lines and over short lines."""

import random

from kindred.llm import paragraphs


def prose(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" + "." * (r.random() < 0.08) for _ in range(n)]


def test_passages_off_the_lines_are_removed(spark):
    passage, short = prose(120, 1), prose(120, 2)
    texts = [" ".join(prose(90 + i, 10 + i) + passage + prose(80, 50 + i)) for i in range(8)]
    texts += ["\n".join([" ".join(prose(60, 100 + i))] + [" ".join(short[k:k + 8]) for k in range(0, 120, 8)]) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in paragraphs.dedup_paragraphs(docs).collect()}
    for i, text in enumerate(texts):
        words, left = text.split(), got[i]["cleaned"].split()
        if i in (0, 8):
            assert got[i]["cleaned"] == text and got[i]["n_removed"] == 0
        else:
            assert got[i]["n_removed"] == 1 and 80 <= len(words) - len(left) <= 120
        own = [w for w in words if w not in set(passage) | set(short)]
        assert [w for w in left if w in set(own)] == own  # nothing else went

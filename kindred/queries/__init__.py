"""Registered queries over the given tables, each with its SQL form where SQL can say it."""

from kindred.queries import models, quality, rows, search, sinks, text, trials

MODULES = [text, rows, search, quality, trials, models, sinks]


def registered() -> dict:
    """name -> (callable(spark, folder), SQL or None)"""
    out = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out

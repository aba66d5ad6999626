"""Registered queries with their SQL twins, one per operator."""

from importlib import import_module

_AREAS = ["signals", "ledger", "calls", "chats", "texts", "streams"]


def _load():
    for area in _AREAS:
        import_module(f"tallyweave.checks.{area}")
    return import_module("tallyweave.checks.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)


def flagship_query(spark, folder):
    return all_queries()["flagship_signal_backtest"](spark, folder)

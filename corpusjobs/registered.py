"""The registered queries of the library's own operators and their SQL."""

from __future__ import annotations

from corpusjobs.plans import checks, corpus, measures, merging, ranking, searching, surviving, text, translation
from corpusjobs.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "checks", "corpus", "measures", "merging", "ranking", "searching", "surviving", "text", "translation"]

"""The modules that register queries; each has queries() and oracle_sql()."""

from __future__ import annotations

from lodestream.queries import etl, learning, problems, records, retrieval, services, storage, texts


def modules() -> list:
    return [problems, etl, texts, retrieval, learning, records, storage, services]

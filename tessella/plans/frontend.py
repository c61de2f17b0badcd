"""What a page's path and parameters mean. Plain Python: one small request at a time."""

from __future__ import annotations

#: Kinds of filters; the second name is what a path's third part may say, but any will do.
_KINDS = {"topic": "source", "source": "topic", "category": "source"}


def parse_path(path: str) -> dict[str, str | None]:
    """topic, source and category of /topic/T, /source/S or /category/C, and the other filter of a four-part path,
    whatever its third part is called."""
    out: dict[str, str | None] = {"topic": None, "source": None, "category": None}
    parts = [p for p in path.split("/") if p]
    if len(parts) >= 2 and parts[0] in _KINDS:
        out[parts[0]] = parts[1]
        if len(parts) == 4:
            out[_KINDS[parts[0]]] = parts[3]
    return out


def breadcrumbs(filters: dict[str, str | None], query: str = "") -> list[dict]:
    """One for each filter and the query; the last one is active."""
    out = [{"name": v, "kind": k, "active": False} for k, v in filters.items() if v]
    if query:
        out.append({"name": query, "kind": "query", "active": False})
    if out:
        out[-1]["active"] = True
    return out


def parameters(request: dict, defaults: dict | None = None, appends: dict | None = None, invariants: dict | None = None) -> dict:
    """The request over the defaults; appended values always added; invariants over all."""
    out = {**(defaults or {}), **request}
    for k, v in (appends or {}).items():
        have = out.get(k, [])
        out[k] = [*(have if isinstance(have, list) else [have]), *(v if isinstance(v, list) else [v])]
    return {**out, **(invariants or {})}


def page(number: int, rows: int, total: int) -> dict[str, int]:
    """First row, rows, and number of pages, of pages numbered from 1."""
    return {"start": max(0, number * rows - rows), "rows": rows, "pages": -(-total // rows) if rows else 0}

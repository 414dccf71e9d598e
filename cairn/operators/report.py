"""What a build cost and what an index holds: the build's report, the report on its layout, and the trace of a search."""

from __future__ import annotations

import time
from contextlib import contextmanager


def build_report(phases: list[dict], docs: int, seconds: float) -> dict:
    """Totals of a build from its phases: time, bytes in all and a document, the slowest phase, what was reused."""
    size = sum(p["bytes"] for p in phases)
    made = [p for p in phases if not p["reused"]]
    return {
        "docs": docs, "seconds": seconds, "docs_per_second": round(docs / seconds, 1) if seconds else 0.0, "bytes": size, "bytes_per_doc": round(size / docs, 1) if docs else 0.0,
        "files": sum(p["files"] for p in phases), "phases": len(phases), "reused": len(phases) - len(made), "bytes_written": sum(p["bytes"] for p in made), "slowest": max(made, key=lambda p: p["seconds"])["name"] if made else None,
    }


def optimizer_report(index, tables: dict[str, dict]) -> dict:
    """Which structures that save work at query time the index has, and what they take; a report, nothing is decided by it."""
    cfg = index.config
    size = lambda *names: sum(tables[n]["bytes"] for n in names if n in tables)
    there = lambda *names: "current" if all(n in tables for n in names) else "absent"
    replicas = [n for n in tables if n.startswith("replica_")]
    sortable = [x.name for x in (*cfg.numbers, *cfg.booleans)]
    core = [
        {"kind": "doc-range bounds", "status": there("blocks"), "bytes": size("blocks"), "reason": "top-k reads only blocks of documents whose bound reaches the threshold"},
        {"kind": "impact tiers", "status": there("tiers"), "bytes": size("tiers"), "reason": "top-k ends when lower tiers can't reach the k-th score"},
        {"kind": "sorted replicas", "status": "current" if replicas else "absent", "bytes": size(*replicas), "covered": [n.removeprefix("replica_") for n in replicas], "sortable": sortable, "reason": "sorted pages are read from the front"},
        {"kind": "query bundles", "status": there("bundles"), "bytes": size("bundles"), "reason": "queries of two or three frequent terms are answered from their best documents"},
        {"kind": "label keys", "status": there("authority"), "bytes": size("authority"), "reason": "a query that names a label finds it"},
        {"kind": "document order", "status": "current", "bytes": size("docs"), "reason": "docs lie in order of doc, so a page's rows prune row groups"},
    ]
    total = sum(t["bytes"] for t in tables.values())
    return {"policy": "core first", "core": core, "summary": {"bytes": total, "bytes_for_pruning": sum(c["bytes"] for c in core[:4]), "decisions": len(core), "absent": [c["kind"] for c in core if c["status"] == "absent"]}}


class Trace:
    """Milliseconds by span of one search; spans of one name add up."""

    def __init__(self, on: bool = True):
        self.on, self.spans, self.began = on, {}, time.perf_counter()

    @contextmanager
    def span(self, name: str):
        t = time.perf_counter()
        try:
            yield
        finally:
            if self.on:
                self.spans[name] = self.spans.get(name, 0.0) + (time.perf_counter() - t) * 1000

    def result(self) -> dict:
        return {k: round(v, 1) for k, v in self.spans.items()} | {"total": round((time.perf_counter() - self.began) * 1000, 1)}

"""Filters and sorts: what a caller writes becomes Columns over the docs table, which parquet statistics can prune."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.values import boolean, range_value


@dataclass
class Filters:
    """facets: any of the values; numbers: {"min", "max"}, both inclusive; booleans. Fields combine by AND; null never passes."""

    facets: dict[str, list[str]] = field(default_factory=dict)
    numbers: dict[str, dict] = field(default_factory=dict)
    booleans: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def of(cls, given) -> Filters:
        return given if isinstance(given, Filters) else cls(**(given or {}))

    def __bool__(self) -> bool:
        return bool(self.facets or self.numbers or self.booleans)


def condition(index, filters: Filters, drop_unknown_facets: bool = False) -> Column | None:
    """The filter as one Column, None if nothing is asked. A facet value nobody has passes no document, or with
    `drop_unknown_facets` the facet isn't asked at all; an unknown number or boolean field passes no document."""
    cfg, parts = index.config, []
    known = {f.name: f for f in cfg.facets}
    for name, wanted in filters.facets.items():
        wanted = [str(w) for w in ([wanted] if isinstance(wanted, str) else wanted)]
        if not wanted:
            continue
        if name not in known:
            parts += [] if drop_unknown_facets else [F.lit(False)]
            continue
        if known[name].label_path or drop_unknown_facets:
            rows = index.facets.where((F.col("field") == name) & (F.col("value").isin(wanted) | F.col("label").isin(wanted)))
            found = [r[0] for r in rows.select("value").distinct().collect()]
            if not found:
                parts += [] if drop_unknown_facets else [F.lit(False)]
                continue
            wanted = sorted({*found})
        plain = f"value_{name}"  # one value a document: a comparison that parquet statistics can answer
        parts.append(F.col(plain).isin(*wanted) if plain in index.docs.columns else F.arrays_overlap(F.col(f"facet_{name}"), F.array(*map(F.lit, wanted))))
    kinds = {n.name: n.type for n in cfg.numbers}
    for name, bounds in filters.numbers.items():
        low, high = (range_value(bounds.get(k), kinds.get(name, "double")) for k in ("min", "max"))
        if name not in kinds:
            parts.append(F.lit(False))
            continue
        c = F.col(f"number_{name}")
        parts.append(c.isNotNull())
        parts += [c >= F.lit(low)] if low is not None else []
        parts += [c <= F.lit(high)] if high is not None else []
    names = {b.name for b in cfg.booleans}
    for name, wanted in filters.booleans.items():
        parts.append(F.col(f"boolean_{name}") == boolean(F.lit(str(wanted).lower())) if name in names else F.lit(False))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def sort_spec(index, sort) -> tuple[str, bool] | None:
    """(column, descending) of "-field", "field" or {"field", "order"}; None if the field isn't a number or boolean."""
    if not sort:
        return None
    if isinstance(sort, str):
        name, down = sort.lstrip("-"), sort.startswith("-")
    else:
        name, down = sort.get("field", ""), str(sort.get("order", sort.get("direction", "asc"))).lower() == "desc"
    if any(n.name == name for n in index.config.numbers):
        return f"number_{name}", down
    if any(b.name == name for b in index.config.booleans):
        return f"boolean_{name}", down
    return None


def order_columns(spec: tuple[str, bool] | None, scored: bool = True) -> list[Column]:
    """Sort value (missing last either way), then score, then document."""
    out = []
    if spec:
        c = F.col(spec[0]).cast("int") if spec[0].startswith("boolean_") else F.col(spec[0])
        out.append(c.desc_nulls_last() if spec[1] else c.asc_nulls_last())
    if scored:
        out.append(F.desc("score"))
    return [*out, F.asc("doc")]


def page_bounds(page=1, size=10) -> tuple[int, int, int]:
    """(page, size, offset), page at least 1, size 1 to 100."""
    page, size = max(1, int(page or 1)), max(1, min(100, int(size or 10)))
    return page, size, (page - 1) * size

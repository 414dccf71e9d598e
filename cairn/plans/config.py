"""What an index holds and how it scores: declared, checked against the columns, defaults filled in."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields as dataclass_fields
from pathlib import Path


def _clamp(value, low: int, high: int, default: int) -> int:
    try:
        return max(low, min(high, int(float(value))))
    except (TypeError, ValueError, OverflowError):
        return default


@dataclass(frozen=True)
class TextField:
    """A scored text column. Arrays are joined by spaces."""

    name: str
    path: str = ""
    weight: float = 1.0
    b: float = 0.75
    phrase: bool = False
    phrase_weight: float = 8.0
    proximity: bool = False
    proximity_weight: float = 3.5
    proximity_window: int = 5
    max_proximity_tokens: int = 96
    index_chars: int | None = None
    bundles: bool = True
    bundle_tokens: int | None = None

    @property
    def column(self) -> str:
        return self.path or self.name


@dataclass(frozen=True)
class Facet:
    name: str
    path: str = ""
    label_path: str = ""

    @property
    def column(self) -> str:
        return self.path or self.name


@dataclass(frozen=True)
class Number:
    """type: int, long (rounded), float, double (kept) or date (milliseconds since 1970 in UTC)."""

    name: str
    path: str = ""
    type: str = "int"

    @property
    def column(self) -> str:
        return self.path or self.name


@dataclass(frozen=True)
class Boolean:
    name: str
    path: str = ""

    @property
    def column(self) -> str:
        return self.path or self.name


@dataclass(frozen=True)
class Authority:
    """Labels that answer a query that names them."""

    name: str
    path: str = ""
    weight: int = 1_000_000
    surface_weight: int | None = None
    token_weight: int | None = None
    surface: bool = True
    exact: bool = True
    tokens: bool = True

    @property
    def column(self) -> str:
        return self.path or self.name

    def score(self, kind: str) -> int:
        exact = max(1, int(self.weight))
        if kind == "surface":
            return max(1, int(self.surface_weight if self.surface_weight is not None else exact * 2))
        if kind == "tokens":
            return max(1, int(self.token_weight if self.token_weight is not None else exact * 4 // 5))
        return exact


@dataclass(frozen=True)
class Display:
    name: str
    path: str = ""
    max_chars: int = 0

    @property
    def column(self) -> str:
        return self.path or self.name


@dataclass(frozen=True)
class TypoOptions:
    mode: str = "main-index"
    trigger: str = "zero-or-weak"
    max_edits: int = 2
    max_token_candidates: int = 8
    max_query_plans: int = 5
    max_corrected_searches: int = 3
    weak_result_total: int = 0

    @classmethod
    def clamped(cls, **given) -> TypoOptions:
        limits = {"max_edits": (1, 3), "max_token_candidates": (1, 32), "max_query_plans": (1, 32), "max_corrected_searches": (1, 8), "weak_result_total": (0, 10)}
        out = {}
        for f in dataclass_fields(cls):
            if f.name in limits:
                out[f.name] = _clamp(given.get(f.name, f.default), *limits[f.name], f.default)
        mode = str(given.get("mode", cls.mode)).lower()
        trigger = str(given.get("trigger", cls.trigger)).lower()
        return cls(mode="off" if mode in ("off", "false", "none") else "main-index", trigger="zero" if trigger == "zero" else "zero-or-weak", **out)


@dataclass(frozen=True)
class IndexConfig:
    text: tuple[TextField, ...] = (TextField("title", weight=4.5, b=0.55, phrase=True), TextField("body"))
    facets: tuple[Facet, ...] = ()
    numbers: tuple[Number, ...] = ()
    booleans: tuple[Boolean, ...] = ()
    authority: tuple[Authority, ...] = ()
    display: tuple[Display, ...] = ()
    id_path: str = "id"
    url_path: str = "url"
    k1: float = 1.2
    terms_per_doc: int = 12
    expansion_terms_per_doc: int = 0
    body_chars: int = 6000
    always: tuple[str, ...] = ("title", "categories")
    authority_rows: int = 16
    bundles: bool = False
    bundle_keys: int = 20_000
    bundle_seed_docs: int = 2
    bundle_rows: int = 64
    bundle_terms: int = 3
    bundle_field_tokens: int = 160
    sort_replicas: tuple[tuple[str, str], ...] = ()
    locality: bool = False  # a copy of docs in order of their best terms, for sequential readers
    bounds: bool = True  # tables of bounds on impacts, for searches that don't count their hits
    typo: TypoOptions = field(default_factory=TypoOptions)
    fold: str = "latin"  # or "nfkd": full normalisation by an Arrow UDF

    def is_always(self, f: TextField) -> bool:
        """Fields named (or whose path is) in `always` have no length cap and no budget of terms."""
        return f.name in self.always or f.column in self.always

    def cap(self, f: TextField) -> int:
        """Characters of the field that are indexed; 0: all."""
        return 0 if self.is_always(f) else max(0, int(f.index_chars if f.index_chars is not None else self.body_chars))

    def check(self, columns: list[str]) -> None:
        top = set(columns)
        named = [*self.text, *self.facets, *self.numbers, *self.booleans, *self.authority, *self.display]
        missing = sorted({c.column for c in named if c.column.split(".")[0] not in top})
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}; there are {', '.join(sorted(top))}")
        for n in self.numbers:
            if n.type not in ("int", "long", "float", "double", "date"):
                raise ValueError(f"number {n.name}: unknown type {n.type}")

    @classmethod
    def from_dict(cls, given: dict) -> IndexConfig:
        """The config that dataclasses.asdict gave, also after a way through JSON."""
        kinds = {"text": TextField, "facets": Facet, "numbers": Number, "booleans": Boolean, "authority": Authority, "display": Display}
        held = {k: tuple(kinds[k](**x) for x in v) if k in kinds else v for k, v in given.items()}
        return cls(**held | {"typo": TypoOptions(**given["typo"]), "always": tuple(given["always"]), "sort_replicas": tuple(map(tuple, given["sort_replicas"]))})

    @classmethod
    def from_json(cls, path: str) -> tuple[IndexConfig, str, str]:
        """(config, input, output) of a JSON file; its paths are relative to the file. Layout keys are accepted and ignored."""
        file = Path(path)
        spec = json.loads(file.read_text(encoding="utf-8"))
        resolve = lambda p: str((file.parent / p).resolve()) if p else ""
        names = lambda items: [{"name": i, "path": i} if isinstance(i, str) else i for i in items or []]
        snake = {
            "phraseWeight": "phrase_weight", "proximityWeight": "proximity_weight", "proximityWindow": "proximity_window", "maxProximityTokens": "max_proximity_tokens",
            "indexChars": "index_chars", "queryBundles": "bundles", "queryBundleSeedMaxTokens": "bundle_tokens", "labelPath": "label_path", "maxChars": "max_chars",
            "surfaceWeight": "surface_weight", "tokenWeight": "token_weight",
        }

        def make(kind, item):
            known = {f.name for f in dataclass_fields(kind)}
            return kind(**{k: v for k, v in ((snake.get(k, k), v) for k, v in item.items()) if k in known})

        given: dict = {}
        for key, attribute, kind in (("fields", "text", TextField), ("facets", "facets", Facet), ("numbers", "numbers", Number), ("booleans", "booleans", Boolean), ("authority", "authority", Authority), ("display", "display", Display)):
            if spec.get(key):
                given[attribute] = tuple(make(kind, i) for i in names(spec[key]))
        for key, attribute in (("idPath", "id_path"), ("urlPath", "url_path"), ("bm25fK1", "k1"), ("maxExpansionTermsPerDoc", "expansion_terms_per_doc"), ("bodyIndexChars", "body_chars"), ("authorityMaxRowsPerKey", "authority_rows"), ("queryBundles", "bundles"), ("queryBundleMaxKeys", "bundle_keys"), ("queryBundleMinSeedDocs", "bundle_seed_docs"), ("queryBundleMaxRows", "bundle_rows"), ("queryBundleMaxTerms", "bundle_terms"), ("queryBundleSeedMaxFieldTokens", "bundle_field_tokens"), ("fold", "fold")):
            if key in spec:
                given[attribute] = spec[key]
        if (n := spec.get("targetPostingsPerDoc", spec.get("maxTermsPerDoc"))) is not None:
            given["terms_per_doc"] = n
        if "alwaysIndexFields" in spec:
            given["always"] = tuple(map(str, spec["alwaysIndexFields"]))
        given["sort_replicas"] = tuple((r["field"], "desc" if str(r.get("order", r.get("direction", "asc"))).lower() == "desc" else "asc") for r in spec.get("sortReplicas", []))
        typo = {attribute: spec[key] for key, attribute in (("typoMode", "mode"), ("typoTrigger", "trigger"), ("typoMaxEdits", "max_edits"), ("typoMaxTokenCandidates", "max_token_candidates"), ("typoMaxQueryPlans", "max_query_plans"), ("typoMaxCorrectedSearches", "max_corrected_searches"), ("typoWeakResultTotal", "weak_result_total")) if key in spec}
        given["typo"] = TypoOptions.clamped(**typo)
        return cls(**given), resolve(spec.get("input", "")), resolve(spec.get("output", ""))

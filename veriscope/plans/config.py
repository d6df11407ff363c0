"""Frozen configurations, their hashes, and matrices of variants."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

STRATEGIES = ("fixed", "recursive", "sentence", "document")
MODES = ("dense", "lexical", "hybrid")
RERANKS = ("none", "llm", "cross_encoder")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Chunking:
    strategy: str = "recursive"
    chunk_size: int = 1000
    chunk_overlap: int = 150
    header_fields: tuple[str, ...] = ("title", "source", "published_at")
    header_scope: str = "chunk"
    document_prefix: str = "search_document: "
    language: str = "simple"

    def __post_init__(self) -> None:
        _one_of("strategy", self.strategy, STRATEGIES)
        _one_of("header_scope", self.header_scope, ("chunk", "document"))
        object.__setattr__(self, "header_fields", tuple(self.header_fields))


@dataclass(frozen=True)
class Retrieval:
    mode: str = "dense"
    top_k: int = 5
    fetch_k: int = 20
    rrf_k: int = 60
    rerank: str = "none"
    rerank_model: str | None = None
    max_per_document: int | None = None
    similarity_threshold: float | None = None
    query_prefix: str = "search_query: "
    query_rewrite: bool = False
    query_decompose: bool = False
    max_sub_queries: int = 3
    hyde: bool = False
    clarify: bool = False

    def __post_init__(self) -> None:
        _one_of("mode", self.mode, MODES)
        _one_of("rerank", self.rerank, RERANKS)
        if self.max_sub_queries < 1 or (self.max_sub_queries != 3 and not self.query_decompose):
            raise ValueError("max_sub_queries must be positive and needs query_decompose")
        if self.hyde and self.mode == "lexical":
            raise ValueError("hyde has no effect on lexical retrieval")
        if (self.rerank == "cross_encoder") != bool(self.rerank_model):
            raise ValueError("rerank_model goes with rerank=cross_encoder")
        if self.rerank_model and ":" not in self.rerank_model:
            raise ValueError("rerank_model is <backend>:<model>")

    def pool_size(self) -> int:
        """Candidates to fetch: more than ``top_k`` only where some may be dropped or moved."""
        return self.fetch_k if self.rerank != "none" or self.max_per_document else self.top_k


@dataclass(frozen=True)
class Generation:
    prompt_template: str = "default"
    temperature: float = 0.0
    max_tokens: int = 1024
    allow_abstain: bool = True
    thinking: bool | None = None


@dataclass(frozen=True)
class Models:
    generator: str = "generator"
    embedder: str = "embedder"
    judge: str = "judge"
    verifier: str | None = None


_SECTIONS = {"chunking": Chunking, "retrieval": Retrieval, "generation": Generation, "models": Models}
#: Fields younger than the first runs; at these values they stay out of the hash.
_NEUTRAL = {("retrieval", "rerank_model"): None, ("retrieval", "query_decompose"): False, ("retrieval", "max_sub_queries"): 3, ("retrieval", "hyde"): False, ("retrieval", "clarify"): False}


def _digest(payload: Any) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Config:
    name: str
    description: str = ""
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    models: Models = field(default_factory=Models)
    seed: int = 42

    @classmethod
    def of(cls, data: dict[str, Any]) -> Config:
        """From nested mappings; unknown keys are errors."""
        made: dict[str, Any] = {}
        known = {f.name for f in fields(cls)}
        for key, value in data.items():
            if key not in known:
                raise ValueError(f"unknown field {key}")
            kind = _SECTIONS.get(key)
            if kind and not is_dataclass(value):
                extra = set(value) - {f.name for f in fields(kind)}
                if extra:
                    raise ValueError(f"unknown fields in {key}: {', '.join(sorted(extra))}")
                value = kind(**value)
            made[key] = value
        return cls(**made)

    def payload(self) -> dict[str, Any]:
        out = asdict(self)
        out = {k: v for k, v in out.items() if k not in ("name", "description")}
        for (section, key), neutral in _NEUTRAL.items():
            if out[section][key] == neutral:
                del out[section][key]
        return out

    def hash(self) -> str:
        return _digest(self.payload())

    def index_hash(self) -> str:
        """What decides the chunks and vectors of an index; its language is part of it."""
        return _digest({"chunking": asdict(self.chunking), "embedder": self.models.embedder})

    def warnings(self) -> list[str]:
        r, out = self.retrieval, []
        if self.models.judge == self.models.generator:
            out.append("the judge is the generator: its scores favour its own answers")
        if self.generation.temperature:
            out.append("temperature is not 0: differences between configurations mix with noise")
        if r.rerank != "none" and r.fetch_k <= r.top_k:
            out.append("fetch_k is no more than top_k: there is nothing to rerank")
        return out


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``base`` with ``over``; mappings are merged at any depth."""
    out = {**base, **over}
    for key in base.keys() & over.keys():
        if isinstance(base[key], dict) and isinstance(over[key], dict):
            out[key] = merged(base[key], over[key])
    return out


def matrix(data: dict[str, Any]) -> list[Config]:
    """One configuration for each of ``variants``, merged onto ``base``."""
    return [Config.of(merged(data.get("base", {}), v)) for v in data.get("variants") or [{}]]


def load(path: str) -> list[Config]:
    """A matrix or a single configuration from a JSON or YAML file; ``file:variant`` picks one."""
    file, _, variant = path.rpartition(":") if path.count(":") and not path.endswith((".yml", ".yaml", ".json")) else (path, "", "")
    with open(file, encoding="utf-8") as f:
        text = f.read()
    if file.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml  # optional

        data = yaml.safe_load(text)
    found = matrix(data) if "base" in data or "variants" in data else [Config.of(data)]
    if variant:
        found = [c for c in found if c.name == variant]
        if not found:
            raise ValueError(f"no variant {variant} in {file}")
    return found


def pool_config(config: Config, max_k: int) -> tuple[Config, list[str]]:
    """The configuration that ranks deep enough to read every prefix up to ``max_k``, and what it approximates."""
    r, notes = config.retrieval, []
    fetch = r.fetch_k
    if r.rerank != "none":
        fetch = max(fetch, max_k)
        notes.append(f"reranking sees {fetch} candidates for every k")
    elif r.max_per_document:
        fetch = max(fetch, 4 * max_k)
        notes.append("the cap per document is applied once for every k")
    changed = {**asdict(r), "top_k": max_k, "fetch_k": fetch}
    return Config(config.name, config.description, config.chunking, Retrieval(**changed), config.generation, config.models, config.seed), notes


def option(text: str) -> tuple[str, Any]:
    """``key=value`` with the value as number, list or text."""
    key, eq, value = text.partition("=")
    if not eq:
        raise ValueError(f"not key=value: {text}")

    def one(v: str) -> Any:
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    return key.strip(), [one(x.strip()) for x in value.split(",")] if "," in value else one(value.strip())

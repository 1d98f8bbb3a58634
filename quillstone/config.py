"""Every threshold of the engine in one place."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    # chunking
    chunk_max_chars: int = 4500
    chunk_overlap_chars: int = 350
    chunk_min_chars: int = 200
    #: A line that names the collection in every text that is embedded; none where it is blank.
    identity: str = ""
    #: Most characters of a text that go to the embedder.
    embed_chars: int = 12_000
    #: How often a batch is embedded before it has failed, and the seconds before the second try.
    embed_tries: int = 4
    embed_wait: float = 0.8
    # live retrieval
    top_k: int = 30
    similarity: float = 0.14
    page_radius: int = 3
    expanded_hits: int = 10
    keyword_hits: int = 10
    keyword_floor: float = 0.55
    fusion_weight: float = 0.1
    # multi-variant retrieval
    variant_similarity: float = 0.18
    fallback_similarity: float = 0.06
    fallback_hits: int = 14
    fallback_per_doc: int = 3
    fallback_most: int = 80
    semantic_weight: float = 0.75
    overlap_cap: int = 12
    gate_score: float = 0.26
    gate_soft: float = 0.22
    gate_per_doc: int = 2
    hits_per_doc: int = 15
    neighbour_radius: int = 2
    relative_keep: float = 0.8
    max_docs: int = 8
    max_variants: int = 3
    max_queries: int = 5
    # answers
    answer_doc_score: float = 0.28
    answer_hit_score: float = 0.26
    evidence_chars: int = 28_000
    evidence_parts: int = 30
    snippet_chars: int = 200
    #: Address that the references' links begin with.
    base_url: str = ""
    preview_chars: int = 300
    history_turns: int = 4
    rewrite_chars: int = 300
    name_score: float = 0.6
    named_chunks: int = 3
    # versions
    embed_version: int = 2
    search_version: int = 2
    builds_kept: int = 3
    #: Most queries that are broadcast at once; more are answered in blocks of this size.
    query_block: int = 5_000


def from_environment(env: Mapping[str, str] = os.environ, prefix: str = "QUILLSTONE_") -> Config:
    """The defaults, but for variables such as QUILLSTONE_TOP_K. Blank ones count as unset; one that is no number of its field's kind is an error."""
    kinds = {f.name: type(f.default) for f in fields(Config)}
    given = {name: env.get(prefix + name.upper(), "").strip() for name in kinds}
    return Config(**{name: kinds[name](value) for name, value in given.items() if value})


CONFIG = from_environment()

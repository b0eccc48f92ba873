"""scriptorium: corpus analytics as Spark DataFrame plans."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"
#: Where the main names of the library live; they are imported when first used.
_EXPORTS = {
    "get_session": "session", "Settings": "settings", "get_settings": "settings", "Service": "service", "Workspace": "plans.pipeline",
    "run_pipeline": "plans.pipeline", "build_chunks": "operators.chunking", "build_windows": "operators.chunking", "build_index": "operators.retrieval",
    "search_index": "operators.retrieval", "vector_search": "operators.retrieval", "fuse": "operators.retrieval", "hybrid_search": "operators.retrieval",
    "VectorStore": "sources.indexes", "run_extraction": "operators.extraction", "resolve_entities": "operators.resolution", "build_graph": "operators.graph",
    "Graph": "operators.match", "detect_communities": "operators.communities", "Corpus": "operators.answering", "ask": "operators.answering",
    "run_benchmark": "operators.evaluation", "summarise": "operators.evaluation", "build_report": "operators.evaluation",
}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_EXPORTS[name]}"), name)

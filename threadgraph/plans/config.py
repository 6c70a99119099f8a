"""Operators by name, their defaults and order, and how a request's settings come about."""

from __future__ import annotations

import configparser
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators import community, edges, filters, merge, nearest, rank
from ..schema import Graph, GraphError


@dataclass(frozen=True)
class Operator:
    """``defaults`` has every parameter with the value that holds where none is given; ``active`` likewise."""

    name: str
    apply: Callable
    defaults: dict = field(default_factory=dict)
    active: bool = False
    pairs: Callable | None = None


COMPARATORS: dict[str, Operator] = {}
MODIFIERS: dict[str, Operator] = {}


def comparator(name: str, apply: Callable, active: bool = True, pairs: Callable | None = None, **defaults) -> None:
    """Register an edge generator: (comments, nodes, vectors, **parameters) -> edges; ``pairs`` gives them as pairs of comments."""
    COMPARATORS[name] = Operator(name, apply, defaults, active, pairs)


def modifier(name: str, apply: Callable, active: bool = False, **defaults) -> None:
    """Register a step: (graph, **parameters) -> graph. Steps run in the order of registration."""
    MODIFIERS[name] = Operator(name, apply, defaults, active)


# Fixed values from here on: names, order, parameters and their defaults.
comparator(
    "SameArticleComparator", lambda c, n, v, base_weight, only_root: edges.edges_same_article(n, base_weight, only_root),
    pairs=lambda c, n, v, base_weight, only_root: edges.pairs_same_article(n, base_weight, only_root), base_weight=1.0, only_root=True,
)
comparator(
    "SameCommentComparator", lambda c, n, v, base_weight, only_consecutive: edges.edges_same_comment(n, base_weight, only_consecutive),
    pairs=lambda c, n, v, base_weight, only_consecutive: edges.pairs_same_comment(n, base_weight, only_consecutive), base_weight=1.0, only_consecutive=True,
)
comparator(
    "ReplyToComparator", lambda c, n, v, base_weight, only_root: edges.edges_reply_to(c, n, base_weight, only_root),
    pairs=lambda c, n, v, base_weight, only_root: edges.pairs_reply_to(c, base_weight, only_root), base_weight=1.0, only_root=True,
)
comparator(
    "SimilarityComparator", lambda c, n, v, max_similarity, base_weight, only_root: edges.edges_similarity(c, n, v, max_similarity, base_weight), False,
    pairs=lambda c, n, v, max_similarity, base_weight, only_root: edges.pairs_similarity(c, n, v, max_similarity, base_weight), max_similarity=0.75, base_weight=0.1, only_root=True,
)
comparator(
    "TemporalComparator",
    lambda c, n, v, max_time, base_weight, only_root, honor_max_time: edges.edges_temporal(c, n, max_time if honor_max_time else edges.MAX_TIME, base_weight),
    pairs=lambda c, n, v, max_time, base_weight, only_root, honor_max_time: edges.pairs_temporal(c, max_time if honor_max_time else edges.MAX_TIME, base_weight),
    max_time=1000, base_weight=1.0, only_root=True, honor_max_time=False,
)


def pagerank_settings(num_iterations: int, d: float, edge_type: str, use_power_mode: bool) -> dict:
    if not use_power_mode:
        return {"damping": d, "edge_type": edge_type, "exact": True}
    return {"iterations": num_iterations, "damping": d, "edge_type": edge_type, "tolerance": 1e-6}


modifier("PageRanker", lambda g, **own: rank.pagerank(g, **pagerank_settings(**own)), True, num_iterations=100, d=0.85, edge_type="TEMPORAL", use_power_mode=True)
modifier("CentralityDegreeCalculator", rank.degree, True)
modifier("SizeRanker", rank.size, True)
modifier("VotesRanker", lambda g, use_upvotes, use_downvotes: rank.votes(g, use_upvotes, use_downvotes), True, use_upvotes=True, use_downvotes=True)
modifier("RecencyRanker", lambda g, use_yongest: rank.recency(g, use_yongest), True, use_yongest=False)
modifier("ToxicityRanker", lambda g, window_length, whole_comment: rank.toxicity(g, window_length, whole_comment), window_length=125, whole_comment=True)


def _node_threshold(kind=None):
    return lambda g, threshold, strict, smaller_as, node_weight_type=kind: filters.node_threshold(g, threshold, node_weight_type, strict, smaller_as)


def _node_top(kind=None):
    return lambda g, top_k, strict, descending_order, node_weight_type=kind: filters.node_top(g, top_k, node_weight_type, strict, descending_order)


modifier("GenericNodeWeightFilter", _node_threshold(), threshold=2.0, node_weight_type="DEGREE_CENTRALITY", strict=True, smaller_as=False)
for _name, _kind, _t, _less in (
    ("SizeFilter", "SIZE", 1.0, False), ("PageRankFilter", "PAGERANK", 1.0, False), ("DegreeCentralityFilter", "DEGREE_CENTRALITY", 1.0, False),
    ("RecencyFilter", "RECENCY", 1.0, False), ("VotesFilter", "VOTES", 2.0, False), ("ToxicityFilter", "TOXICITY", 0.5, True),
):
    modifier(_name, _node_threshold(_kind), _name == "VotesFilter", threshold=_t, strict=True, smaller_as=_less)
modifier("GenericNodeWeightBottomFilter", _node_top(), top_k=5, node_weight_type="DEGREE_CENTRALITY", strict=False, descending_order=True)
for _name, _kind, _k, _strict in (
    ("SizeBottomFilter", "SIZE", 5, False), ("PageRankBottomFilter", "PAGERANK", 200, True), ("DegreeCentralityBottomFilter", "DEGREE_CENTRALITY", 5, False),
    ("RecencyBottomFilter", "RECENCY", 5, False), ("VotesBottomFilter", "VOTES", 50, False), ("ToxicityBottomFilter", "TOXICITY", 500, False),
):
    modifier(_name, _node_top(_kind), _name == "PageRankBottomFilter", top_k=_k, strict=_strict, descending_order=True)


def _edge_threshold(kind=None):
    return lambda g, threshold, smaller_as, edge_type=kind: filters.edge_threshold(g, threshold, edge_type, smaller_as)


def _edge_top(kind=None):
    return lambda g, top_edges, descending_order, edge_type=kind: filters.edge_top(g, top_edges, edge_type, descending_order)


def _merger(kind=None):
    return lambda g, threshold, smaller_as, edge_weight_type=kind: merge.merge(g, threshold, edge_weight_type, smaller_as)


def _clusterer(kind=None):
    return lambda g, algorithm, edge_weight_type=kind: community.cluster(g, edge_weight_type, algorithm)


TYPES = {"reply_to": "REPLY_TO", "same_article": "SAME_ARTICLE", "similarity": "SIMILARITY", "same_group": "SAME_GROUP", "same_comment": "SAME_COMMENT", "temporal": "TEMPORAL"}


def _by_type(suffix: str, values: dict) -> dict[str, float]:
    return {kind: values[f"{name}{suffix}"] for name, kind in TYPES.items()}


modifier("GenericEdgeFilter", _edge_threshold(), threshold=0.13, smaller_as=False, edge_type="REPLY_TO")
for _name, _kind, _t in (
    ("SimilarityEdgeFilter", "SIMILARITY", 0.3), ("ReplyToEdgeFilter", "REPLY_TO", 0.5), ("SameCommentEdgeFilter", "SAME_COMMENT", 0.5),
    ("SameArticleEdgeFilter", "SAME_ARTICLE", 0.5), ("SameGroupEdgeFilter", "SAME_GROUP", 0.5), ("TemporalEdgeFilter", "TEMPORAL", 0.5),
):
    modifier(_name, _edge_threshold(_kind), threshold=_t, smaller_as=False)
modifier(
    "OrEdgeFilter", lambda g, **t: filters.edge_any(g, _by_type("_threshold", t)),
    reply_to_threshold=0.5, same_article_threshold=-0.5, similarity_threshold=-0.5, same_group_threshold=-0.5, same_comment_threshold=0.5, temporal_threshold=0.5,
)
modifier("GenericBottomEdgeFilter", _edge_top(), top_edges=2, descending_order=True, edge_type="REPLY_TO")
for _name, _kind, _k in (
    ("BottomSimilarityEdgeFilter", "SIMILARITY", 5), ("BottomReplyToEdgeFilter", "REPLY_TO", 100), ("BottomTemporalEdgeFilter", "TEMPORAL", 100),
    ("BottomSameCommentFilter", "SAME_COMMENT", 100), ("BottomSameArticleEdgeFilter", "SAME_ARTICLE", 100), ("BottomSameGroupEdgeFilter", "SAME_GROUP", 100),
):
    modifier(_name, _edge_top(_kind), top_edges=_k, descending_order=True)
modifier("GenericNodeMerger", _merger(), threshold=0.5, smaller_as=False, edge_weight_type="SAME_COMMENT")
for _name, _kind, _t in (
    ("SimilarityNodeMerger", "SIMILARITY", 0.11), ("ReplyToNodeMerger", "REPLY_TO", 0.5), ("SameCommentNodeMerger", "SAME_COMMENT", 0.5),
    ("SameArticleNodeMerger", "SAME_ARTICLE", 0.5), ("SameGroupNodeMerger", "SAME_GROUP", 0.5), ("TemporalNodeMerger", "TEMPORAL", 0.12),
):
    modifier(_name, _merger(_kind), _name == "ReplyToNodeMerger", threshold=_t, smaller_as=False)
modifier(
    "MultiNodeMerger", lambda g, smaller_as, conj_or, **t: merge.merge_multi(g, _by_type("_threshold", t), smaller_as, conj_or),
    reply_to_threshold=0.5, same_article_threshold=-0.5, similarity_threshold=-0.5, same_group_threshold=-0.5, same_comment_threshold=0.5, temporal_threshold=-0.5, smaller_as=False, conj_or=True,
)
modifier("GenericClusterer", _clusterer(), edge_weight_type="SAME_COMMENT", algorithm="GirvanNewman")
for _name, _kind in (
    ("SimilarityClusterer", "SIMILARITY"), ("ReplyToClusterer", "REPLY_TO"), ("SameCommentClusterer", "SAME_COMMENT"),
    ("SameArticleClusterer", "SAME_ARTICLE"), ("SameGroupClusterer", "SAME_GROUP"), ("TemporalClusterer", "TEMPORAL"),
):
    modifier(_name, _clusterer(_kind), algorithm="GirvanNewman")
modifier(
    "MultiEdgeTypeClusterer", lambda g, algorithm, **use: community.cluster_multi(g, [kind for name, kind in TYPES.items() if use[f"use_{name}"]], algorithm),
    use_reply_to=True, use_same_article=False, use_similarity=False, use_same_group=False, use_same_comment=True, use_temporal=False, algorithm="GirvanNewman",
)
modifier(
    "GenericSingleEdgeAdder", lambda g, base_weight, edge_weight_type, node_weight_type: nearest.add_single_edges(g, base_weight, edge_weight_type, node_weight_type),
    True, base_weight=0.1, edge_weight_type="TEMPORAL", node_weight_type="RECENCY",
)


def _typed(value, default):
    """A setting of a file or request as the type of its default; an enum member's name may come with its class."""
    if isinstance(value, str):
        if isinstance(default, bool):
            low = value.strip().lower()
            if low not in configparser.ConfigParser.BOOLEAN_STATES:
                raise GraphError(f"not a boolean: {value}")
            return configparser.ConfigParser.BOOLEAN_STATES[low]
        if isinstance(default, int):
            return int(value)
        if isinstance(default, float):
            return float(value)
        return value.rpartition(".")[2]
    return type(default)(value) if isinstance(default, (int, float)) and not isinstance(value, bool) else value


def read_ini(text: str) -> dict[str, dict]:
    parser = configparser.ConfigParser()
    parser.optionxform = str
    parser.read_string(text)
    return {section: dict(parser[section]) for section in parser.sections()}


def resolve(overrides: dict[str, dict] | None = None, base: dict[str, dict] | None = None) -> dict[str, dict | None]:
    """Parameters of each operator, or None if it is off. ``overrides`` go before ``base`` (a file), that before the defaults.

    An operator with settings and no ``active`` among them is on.
    """
    given: dict[str, dict] = {}
    for part in (base or {}, overrides or {}):
        for name, settings in part.items():
            given.setdefault(name, {}).update({k: v for k, v in settings.items() if v is not None})
    known = COMPARATORS | MODIFIERS
    out: dict[str, dict | None] = {}
    for name, op in known.items():
        settings = dict(given.get(name, {}))
        active = _typed(settings.pop("active", True if name in given else op.active), True)
        unknown = set(settings) - set(op.defaults)
        if unknown:
            raise GraphError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        out[name] = {k: _typed(settings.get(k, v), v) for k, v in op.defaults.items()} if active else None
    return out


def run_step(graph: Graph, name: str, parameters: dict) -> Graph:
    return MODIFIERS[name].apply(graph, **parameters)

"""The benchmark's configurations: one generator, a ranker where one is needed, and one step each."""

from __future__ import annotations

from .config import COMPARATORS, MODIFIERS

# Labels, operators and parameters.
GENERATORS = {
    "SC": ("SameCommentComparator", {"base_weight": 1.0, "only_consecutive": True}),
    "SA": ("SameArticleComparator", {"base_weight": 1.0, "only_root": True}),
    "RT": ("ReplyToComparator", {"base_weight": 1.0, "only_root": True}),
    "T": ("TemporalComparator", {"base_weight": 1.0, "only_root": True}),
    "S": ("SimilarityComparator", {"max_similarity": 0.75, "base_weight": 0.1, "only_root": True}),
}
TYPES = {"SC": "SAME_COMMENT", "SA": "SAME_ARTICLE", "RT": "REPLY_TO", "T": "TEMPORAL", "S": "SIMILARITY"}
NAMES = {"SC": "SameComment", "SA": "SameArticle", "RT": "ReplyTo", "T": "Temporal", "S": "Similarity"}
TOP = {"top_k": 50, "strict": False, "descending_order": True}
OVER = {"threshold": 0.001, "strict": False, "smaller_as": False}


def only(operators: dict[str, dict]) -> dict[str, dict]:
    """Settings under which nothing but the given operators is on."""
    return {name: {"active": False} for name in (*COMPARATORS, *MODIFIERS)} | {name: {"active": True, **own} for name, own in operators.items()}


def _config(generator: str, ranker: dict, step: tuple[str, dict], **changed) -> dict[str, dict]:
    name, own = GENERATORS[generator]
    return only({name: own | changed} | ranker | {step[0]: step[1]})


def _pagerank(generator: str, iterations: int = 10, d: float = 0.85) -> dict:
    return {"PageRanker": {"num_iterations": iterations, "d": d, "edge_type": TYPES[generator], "use_power_mode": True}}


def sweeps() -> list[tuple[str, dict[str, dict]]]:
    """(label, settings) of all 52 configurations; three labels come twice."""
    out = []
    for label, generator, iterations, d, changed, generated in (
        ("SC_PRB_k50", "SC", 10, 0.85, {}, {}),
        ("SC_PRB_it100", "SC", 100, 0.85, {}, {}),
        ("SC_PRB_d0.5", "SC", 10, 0.5, {}, {}),
        ("SC_PRB_k100", "SC", 10, 0.85, {"top_k": 100}, {}),
        ("SC_PRB_strict", "SC", 10, 0.85, {"strict": True}, {}),
        ("SC_PRB_asc", "SC", 10, 0.85, {"descending_order": False}, {}),
        ("SC_PRB_no_consec", "SC", 10, 0.85, {"descending_order": False}, {"only_consecutive": False}),
        ("RT_PRB", "RT", 10, 0.85, {}, {}),
        ("SA_PRB", "SA", 10, 0.85, {}, {}),
        ("T_PRB", "T", 10, 0.85, {}, {}),
        ("S_PRB", "S", 10, 0.85, {}, {}),
        ("S_PRB_strict", "S", 10, 0.85, {"strict": True}, {}),
    ):
        out.append((label, _config(generator, _pagerank(generator, iterations, d), ("PageRankBottomFilter", TOP | changed), **generated)))
    for label, changed in (
        ("SC_PR_t0005", {"threshold": 0.0005}),
        ("SC_PR_t001", {}),
        ("SC_PR_t005", {"threshold": 0.005}),
        ("SC_PR_t001", {}),
        ("SC_PR_strict", {"strict": True}),
        ("SC_PR_smaller", {"smaller_as": True}),
    ):
        out.append((label, _config("SC", _pagerank("SC"), ("PageRankFilter", OVER | changed))))
    both = {"use_upvotes": True, "use_downvotes": True}
    for label, generator, ranker, step, own in (
        ("SC_CD", "SC", {"CentralityDegreeCalculator": {}}, "DegreeCentralityFilter", OVER | {"threshold": 0.0005}),
        ("SC_CDB", "SC", {"CentralityDegreeCalculator": {}}, "DegreeCentralityBottomFilter", TOP),
        ("S_TB", "SC", {"ToxicityRanker": {"window_length": 125, "whole_comment": True}}, "ToxicityBottomFilter", TOP),
        ("S_V", "S", {"VotesRanker": both}, "VotesFilter", OVER | {"threshold": 5}),
        ("S_VB", "S", {"VotesRanker": both}, "VotesBottomFilter", TOP),
        ("SC_VB", "SC", {"VotesRanker": both}, "VotesBottomFilter", TOP),
        ("SC_VB_strict", "SC", {"VotesRanker": both}, "VotesBottomFilter", TOP | {"strict": True}),
        ("SC_SB", "SC", {"SizeRanker": {}}, "SizeBottomFilter", TOP),
        ("SC_SB_strict", "SC", {"SizeRanker": {}}, "SizeBottomFilter", TOP | {"strict": True}),
        ("SC_RB", "SC", {"RecencyRanker": {"use_yongest": True}}, "RecencyBottomFilter", TOP),
        ("SC_RB_strict", "SC", {"RecencyRanker": {"use_yongest": True}}, "RecencyBottomFilter", TOP | {"strict": True}),
        ("SC_RB", "SC", {"RecencyRanker": {"use_yongest": False}}, "RecencyBottomFilter", TOP),
        ("SC_RB_strict", "SC", {"RecencyRanker": {"use_yongest": False}}, "RecencyBottomFilter", TOP | {"strict": True}),
    ):
        out.append((label, _config(generator, ranker, (step, own))))
    for generator in ("SC", "SA", "RT", "T", "S"):
        for digits in ("01", "001", "0001"):
            out.append((f"{generator}_merge_{digits}", _config(generator, {}, (f"{NAMES[generator]}NodeMerger", {"threshold": float(f"0.{digits}"), "smaller_as": False}))))
    for generator in ("SC", "SA", "RT"):
        for label, algorithm in (("GN", "girvannewman"), ("GMC", "gmc")):
            out.append((f"{generator}_cluster_{label}", _config(generator, {}, (f"{NAMES[generator]}Clusterer", {"algorithm": algorithm}))))
    return out

"""Word lists and numbers that the retrieval and evidence operators take as parameters.

The defaults are for a library of English and Chinese papers; pass another Lexicon or Settings for other material.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Lexicon:
    # They decide routes, boosts and features, so results depend on each word.
    comparison: tuple[str, ...] = ("compare", "difference", "versus", "相比", "比较", "区别", "对比", "差异")
    summary: tuple[str, ...] = ("summary", "综述", "总结", "概述", "概括", "梳理", "归纳")
    experiment: tuple[str, ...] = ("protocol", "步骤", "实验", "construct", "design", "流程", "方案设计")
    factoid: tuple[str, ...] = ("what", "how", "why", "是否", "能否", "是什么", "有没有", "哪些", "哪种", "哪两个", "哪几种", "为什么", "原因", "作用", "机制", "如何", "请只基于证据回答", "根据文库")
    review: tuple[str, ...] = ("review", "综述", "perspective", "overview", "progress")
    table: tuple[str, ...] = ("table", "primer", "sequence", "strain", "vmax", "km", "relative peak area", "glycan", "parameter")
    figure: tuple[str, ...] = ("figure", "fig.", "fig ", "图")
    result: tuple[str, ...] = ("yield", "production", "produced", "titer", "titre", "result", "increase", "increased", "decrease", "decreased", "improved", "enhanced", "产量", "产率", "滴度", "提高", "降低", "增加", "减少", "结果")
    definition: tuple[str, ...] = ("defined as", "is defined", "acts as", "act as", "functions as", "function as", "refers to", "known as", "termed", "指", "定义为")
    existence: tuple[str, ...] = ("is there", "are there", "any evidence", "does the library", "有没有", "是否有", "是否存在", "文库中是否")
    body_sections: tuple[str, ...] = ("Introduction", "Background", "Methods", "Materials and Methods", "Experimental Section", "Experimental Procedures", "Results", "Results and Discussion", "Discussion", "Conclusion", "Conclusions", "Full Text")
    anchor_words: tuple[str, ...] = ("km", "vmax", "hmos", "glycom", "man8", "man7", "man10")
    stop_words: tuple[str, ...] = ("a", "an", "and", "are", "as", "by", "describe", "described", "does", "for", "in", "is", "listed", "main", "of", "on", "shown", "the", "their", "these", "this", "to", "values", "what", "which")
    #: Groups of names for one thing: a question that has one of them looks for all.
    aliases: tuple[tuple[str, ...], ...] = (
        ("2′-fl", "2'-fl", "2-fucosyllactose", "20-fucosyllactose"), ("6′-sl", "6'-sl", "6-sialyllactose", "6′-sialyllactose"),
        ("wcfb",), ("salvage", "gdp-l-fucose", "gdp fucose"), ("crispr-tmsd", "tmsd", "strand displacement"),
    )
    #: Of a question that asks for a route (``route_markers``): what stands for the pathway of each thing it names.
    pathways: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("2′-fl", ("gdp-l-fucose", "gdp-fucose", "alpha-1,2-fucosyltransferase", "fuct", "lactose", "biosynthesis")), ("2'-fl", ("gdp-l-fucose", "gdp-fucose", "alpha-1,2-fucosyltransferase", "fuct", "lactose", "biosynthesis")),
        ("6′-sl", ("cmp-neu5ac", "sialyltransferase", "alpha-2,6-sialyltransferase", "lactose", "biosynthesis")), ("6'-sl", ("cmp-neu5ac", "sialyltransferase", "alpha-2,6-sialyltransferase", "lactose", "biosynthesis")),
    )
    #: Branches that a comparison names by one of the first words, and the words of which evidence has one.
    named_branches: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
        (("6′-sl", "6'-sl"), ("6′-sl", "cmp-neu5ac", "sialyltransferase")), (("2′-fl", "2'-fl"), ("2′-fl", "gdp-l-fucose", "fucosyltransferase")), (("wcfb",), ("wcfb",)),
        (("salvage", "补料"), ("salvage", "gdp-l-fucose")), (("染色体整合", "chromosomal integration"), ("chromosomally", "integration", "染色体整合")),
    )
    negative: tuple[str, ...] = ("review", "progress", "covid", "sars", "protective effect", "inflammation")
    core_phrases: tuple[str, ...] = ("工业规模", "industrial scale", "industrial-scale", "溶解氧", "dissolved oxygen", "control strategy", "控制策略", "详细方案", "systematic review", "系统综述", "临床试验", "clinical trial", "phase iii", "iii 期", "发酵工艺", "fermentation process", "protocol", "review", "trial", "data")
    generic_terms: tuple[str, ...] = ("文库", "当前文库", "知识库", "资料", "数据", "方案", "详细方案", "系统综述", "临床试验", "工艺", "策略", "报告", "protocol", "review", "trial", "data", "scheme", "strategy")
    generic_branches: tuple[str, ...] = ("策略", "机制", "作用", "用途", "角色", "方法", "路径", "差异", "区别", "方案", "一类", "另一类", "一种", "另一种", "两类", "两种", "strategy", "mechanism", "role", "usage", "function")
    overclaims: tuple[str, ...] = ("完整回答如下", "可以完整回答", "可以确定文库中完整包含", "两者均已充分证明", "可以确认文库中完整包含", "完整比较", "完整回答", "充分证明", "均已充分支持", "可以确定", "完全支持", "文库已经证明", "明确证明两者", "无需额外证据", "已完整覆盖", "fully supported", "complete comparison", "conclusively proves", "sufficient evidence for all", "definitely confirms")
    existence_overclaims: tuple[str, ...] = ("文库中有该详细方案", "文库中有完整详细方案", "已提供完整方案", "可以确认包含", "可以确认文库中有")
    branch_limits: tuple[str, ...] = ("不足", "缺失", "无法", "不能完整比较", "不能逐分支", "不能确认", "证据限制")
    indirect_limits: tuple[str, ...] = ("间接", "有限比较", "不能完整比较", "不能逐分支", "证据限制")
    partial_limits: tuple[str, ...] = (
        "有限比较", "有限回答", "只能支持部分", "当前证据只能", "当前文库只能", "在文库所支持的范围内", "证据不足以", "不能完整", "不能逐分支", "不能逐分支完整比较", "无法完整", "缺乏直接", "仅提供间接", "部分支持", "证据分布不均衡", "尚不能", "不能确认",
        "limited comparison", "partial support", "insufficient evidence", "indirect evidence", "cannot fully", "not enough evidence",
        "有限总结", "有限支持", "当前知识库仅提供", "当前知识库只能支持有限总结", "仅检索到一条", "仅有一条", "只检索到一条", "一条直接相关证据", "以下总结仅基于", "只能覆盖该证据涉及的范围", "尚不足以完整阐明", "不足以完整阐明", "未直接说明", "未涉及", "暂未涵盖",
        "尚无其他证据", "缺少更细化", "不能视为完整综述", "不能完整总结", "只能覆盖部分", "证据较少", "证据有限", "limited summary", "limited support", "only one direct evidence", "based only on this evidence", "insufficient to fully explain", "does not directly explain", "not covered", "cannot fully summarize", "partial evidence",
        "Limited evidence",
    )
    existence_disclaimers: tuple[str, ...] = ("不能确认文库中包含",)
    negations: tuple[str, ...] = ("不能", "无法", "尚不能", "不可", "不应", "not ", "cannot ", "can't ")
    strategies: tuple[tuple[str, ...], ...] = (
        ("salvage", "gdp-l-fucose", "gdp fucose", "补料", "补救"), ("wcfb", "fucosyltransferase", "末端转移", "岩藻糖基转移酶"),
        ("chromosomal integration", "chromosomally integrated", "chromosomally integration", "染色体整合", "integrated expression cassette"),
    )
    route_markers: tuple[str, ...] = ("工程化", "合成路径", "关键前体", "催化步骤", "biosynthesis", "pathway", "precursor")
    route_positive: tuple[str, ...] = ("biosynthesis", "production", "engineered", "metabolic engineering", "synthesis", "pathway", "cmp-neu5ac", "gdp-l-fucose", "gdp-fucose", "sialyltransferase", "fucosyltransferase")
    route_negative: tuple[str, ...] = ("protective effect", "covid", "sars", "necrotizing", "inflammation", "treatment", "review", "progress", "application", "health effects")


@dataclass(frozen=True)
class Settings:
    """Numbers of the retrieval, rerank and evidence stages."""

    search_limit: int = 40
    dense_limit: int = 40
    bm25_limit: int = 40
    rerank_top_k: int = 10
    final_top_k: int = 8
    score_floor: float = 0.05
    rrf_k: int = 60
    max_filter_items: int = 20
    cjk_bm25_weight: float = 0.25
    comparison_weight: float = 1.1
    subquery_weight: float = 0.9
    per_doc_cap: int = 3
    title_boost: float = 0.08
    table_text_boost: float = 0.10
    table_caption_boost: float = 0.06
    figure_caption_boost: float = 0.08
    rerank_alpha: float = 0.15
    strategy_bonus: float = 0.1
    guarded_weights: tuple[float, ...] = (0.45, 0.15, 0.25, 0.10, 0.05, 0.18)
    guard_gain: float = 0.18
    guard_gap: float = 0.20
    evidence_bonus: tuple[float, ...] = (0.20, 0.22, 0.06)
    section_bonus: tuple[float, ...] = (0.35, 0.28, 0.0, -0.05)
    floor_ratio: float = 0.4
    neighbor_window: int = 2
    neighbor_cap: int = 30
    k1: float = 1.5
    b: float = 0.75
    answer_threshold: float = 0.58
    citation_threshold: float = 0.45
    kept_turns: int = 12
    max_factoid: int = 3
    max_summary: int = 5
    max_comparison: int = 6
    min_support: float = 0.0
    require_citation: bool = True
    audit_window: int = 1
    audit_per_seed: int = 2
    audit_decay: tuple[float, float] = (0.45, 0.25)
    audit_floor: float = 0.05
    chunk_words: int = 800
    overlap_words: int = 120
    comparison_coverage: bool = False
    neighbor_audit: bool = False
    rewrite: bool = False
    promote_neighbors: bool = False
    external_write: bool = False
    lexicon: Lexicon = field(default_factory=Lexicon)

    #: What a profile sets; two switches stay off whatever is asked for.
    PROFILES = {"stable": {}, "rewrite": {"rewrite": True}, "comparison": {"rewrite": True, "comparison_coverage": True}, "debug": {"rewrite": True, "comparison_coverage": True, "neighbor_audit": True}}
    FORBIDDEN = ("promote_neighbors", "external_write")

    @staticmethod
    def of(profile: str = "stable", env: dict[str, str] | None = None, prefix: str = "LODESTRATA_", **explicit) -> Settings:
        """Defaults, then the profile, then the environment (LODESTRATA_<NAME>), then arguments; forbidden switches are put off at the end."""
        if profile not in Settings.PROFILES:
            raise ValueError(f"unknown profile {profile}; there are {sorted(Settings.PROFILES)}")
        values = dict(Settings.PROFILES[profile])
        env = os.environ if env is None else env
        for f in fields(Settings):
            if (raw := env.get(prefix + f.name.upper())) is not None and f.name != "lexicon":
                default = getattr(Settings, f.name)
                values[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else tuple(float(x) for x in raw.split(",")) if isinstance(default, tuple) else type(default)(raw)
        return replace(Settings(), **(values | explicit | dict.fromkeys(Settings.FORBIDDEN, False)))

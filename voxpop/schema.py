"""Labels, taxonomies and canonical column names.

A taxonomy is data: ordered ``(label, ordinal, pattern)`` rows plus a default
label. Rule scorers test the patterns in ordinal order; the first match wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
DEMAND_LABELS = ["基础层", "保障层", "舒适层", "尊重层", "共鸣层", "其他"]
DEMAND_LABELS_ALT = ["基础层", "保障层", "舒适层", "尊重层", "自我实现层", "其他"]
DEMAND_DEFAULT = "其他"
SENTIMENT_LABELS = ["正面", "中性", "负面"]
SENTIMENT_CODES = {"正面": 1, "中性": 0, "负面": -1}
SENTIMENT_DEFAULT = "中性"
FACTOR_NONE = "无法提取"
FACTOR_ERROR = "API错误"
FACTOR_SENTINELS = [FACTOR_NONE, FACTOR_ERROR]
FACTOR_SEPARATOR = "，"
NAME_FALLBACK_PREFIX = "【自动生成】"
TOTAL_ROW_LABEL = "总体"
SCORE_TEXT_LIMIT = 500
PREVIEW_LIMIT = 100
FACTOR_MIN_LEN = 2
FACTOR_MAX_LEN = 5
FALLBACK_NAME_LIMIT = 50
SWEEP_INIT_THRESHOLD = 0.77
SWEEP_POINTS = 15
# Export header names of the reference's files (engine names on the right).
EXPORT_NAMES = {
    "text": "微博原文",
    "demand": "需求层次",
    "sentiment": "情感标签",
    "sentiment_code": "情感数值",
    "factors_text": "情感因素",
    "n_factors": "因素数量",
    "ordinal": "序号",
    "error": "错误信息",
    "n": "数量",
    "share_pct": "占比",
    "label": "类别",
    "precision": "精确率",
    "recall": "召回率",
    "f1": "F1分数",
    "support": "支持数",
    "accuracy": "准确率",
    "cluster_id": "簇ID",
    "cluster_size": "簇大小",
}

# Cue words for the built-in rule scorers: defaults that a caller replaces by
# passing another taxonomy.
DEMAND_CUES = {
    "基础层": ["安检", "故障", "延误", "急刹", "安全", "准点"],
    "保障层": ["设施", "电梯", "扶梯", "直达", "支付", "诉求", "动线", "通车", "运营"],
    "舒适层": ["卫生", "温度", "湿度", "空调", "冷", "热", "空气", "座椅", "座位", "提示音", "音量", "报站", "看板", "指引", "拥挤", "无障碍"],
    "尊重层": ["工作人员", "服务态度", "关怀", "隐私", "文化", "节日", "毕业季", "广播", "主题车站", "盖章"],
    "共鸣层": ["怀念", "向往", "自豪", "纪念", "归属感"],
}
DEMAND_CUES_ALT = {
    "基础层": ["安检", "故障", "延误", "急刹"],
    "保障层": ["设施", "电梯", "扶梯", "直达", "支付", "诉求", "动线"],
    "舒适层": ["卫生", "拥挤", "空调", "冷", "热", "座位"],
    "尊重层": ["工作人员", "服务态度", "关怀", "隐私", "互动"],
    "自我实现层": ["文化", "归属感", "城市认同", "节日", "毕业季", "超话"],
}
# Sentiment cue order: comparison cues, then negative, then positive.
SENTIMENT_RULES = [
    ("正面", ["比以前好"]),
    ("负面", ["不如", "不满", "批评", "抱怨", "太低", "耽误", "不舒服", "窒息", "太冷", "太热", "希望改进", "拥挤"]),
    ("正面", ["认可", "满意", "怀念", "向往", "自豪", "纪念", "赞赏", "热情", "清晰", "干净", "舒适", "很好", "凉快", "熟悉", "贴心", "温暖"]),
]
# Cue -> factor dictionary of the built-in factor extractor (examples of the
# reference's factor prompt and its published top themes).
FACTOR_CUES = [
    ("列车空调", "列车空调"),
    ("空调", "列车空调"),
    ("安检", "安检服务"),
    ("毕业季", "毕业季装饰"),
    ("十几年", "地铁历史"),
    ("祝福", "暖心祝福"),
    ("播报", "暖心播报"),
    ("拥挤", "车厢拥挤"),
    ("电梯", "电梯设施"),
    ("扶梯", "电梯设施"),
    ("设施", "设施不足"),
    ("服务", "服务贴心"),
    ("延误", "运行延误"),
    ("故障", "设备故障"),
]
# ---------------------------------------------------------------------------

def literal_alternation(words: list[str]) -> str:
    """A regex that matches any of the given literal words (first listed word wins at a position)."""
    return "|".join(re.escape(w) for w in words)


def literal_trie(words: list[str]) -> str:
    """Same matches as :func:`literal_alternation`, as a prefix trie.

    Leftmost-first alternation picks the first listed word that matches at a
    position. Words that differ at some character can never both match there,
    so grouping by the next character keeps the result as long as the listed
    order is kept inside each group. A word that ends inside the trie matches
    before every later word sharing its prefix, so it closes the group as an
    empty branch and the later words are dropped (they can never win). The regex engine then tests one character
    per position instead of every word.
    """

    def build(ws: list[str]) -> str:
        groups: dict[str, list[str]] = {}
        order: list[str] = []
        for w in ws:
            k = w[:1]
            if k == "":  # a word ends here: it matches first, later words with this prefix never win
                order.append("")
                break
            if k not in groups:
                groups[k] = []
                order.append(k)
            groups[k].append(w[1:])
        branches = []
        for k in order:
            if k == "":
                branches.append("")
                continue
            rest = groups[k]
            if rest == [""]:
                branches.append(re.escape(k))
            else:
                branches.append(re.escape(k) + build(rest))
        if len(branches) == 1:
            b = branches[0]
            return b if len(b) <= 1 or b.startswith("\\") and len(b) == 2 else "(?:" + b + ")"
        return "(?:" + "|".join(branches) + ")"

    seen: list[str] = []
    for w in words:
        if w and w not in seen:
            seen.append(w)
    return build(seen) if seen else "(?!)"


@dataclass(frozen=True)
class Taxonomy:
    """Ordered closed label set with one regex per label and a default label."""

    labels: tuple[str, ...]
    patterns: tuple[str | None, ...]
    default: str
    name: str = "label"
    extra: dict = field(default_factory=dict, compare=False)
    #: The (label, words) that the patterns stand for.
    cues: tuple = field(default=(), compare=False)

    @staticmethod
    def from_cues(cues: dict[str, list[str]] | list[tuple[str, list[str]]], default: str, name: str = "label",
                  all_labels: list[str] | None = None) -> "Taxonomy":
        items = list(cues.items()) if isinstance(cues, dict) else list(cues)
        labels = [lab for lab, _ in items]
        patterns = [literal_trie(ws) for _, ws in items]
        for lab in all_labels or []:
            if lab not in labels:
                labels.append(lab)
                patterns.append(None)
        if default not in labels:
            labels.append(default)
            patterns.append(None)
        return Taxonomy(tuple(labels), tuple(patterns), default, name, cues=tuple(items))

    @property
    def categories(self) -> list[str]:
        """Distinct labels in first-ordinal order (a label may own several rules)."""
        if self.extra.get("order"):
            return list(self.extra["order"])
        seen: list[str] = []
        for lab in self.labels:
            if lab not in seen:
                seen.append(lab)
        return seen

    def rules(self) -> list[tuple[str, str]]:
        return [(lab, pat) for lab, pat in zip(self.labels, self.patterns) if pat]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """Dimension table ``(label, ordinal)``: one row per category."""
        from pyspark.sql import functions as F

        rows = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(i).alias("ordinal"))
                         for i, lab in enumerate(self.categories)])
        return spark.range(1).select(F.inline(rows))


def demand_taxonomy(alternate: bool = False) -> Taxonomy:
    if alternate:
        return Taxonomy.from_cues(DEMAND_CUES_ALT, DEMAND_DEFAULT, "demand", DEMAND_LABELS_ALT)
    return Taxonomy.from_cues(DEMAND_CUES, DEMAND_DEFAULT, "demand", DEMAND_LABELS)


def sentiment_taxonomy(subject: str = "南京地铁") -> Taxonomy:
    """``subject``: what the posts are about; "not as good as" it is praise."""
    (label, cues), *rest = SENTIMENT_RULES
    t = Taxonomy.from_cues([(label, [f"不如{subject}", *cues]), *rest], SENTIMENT_DEFAULT, "sentiment")
    # categories must follow the fixed order 正面/中性/负面 for reports
    return replace(t, extra={"order": SENTIMENT_LABELS})

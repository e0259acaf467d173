"""Synthetic corpus text, deterministic per id.

Template ``id mod 10``; one topic word is substituted; further copies of the same template
with other words are appended (space separated) until the text reaches ``min_length``; the
text is cut at ``max_length`` and stripped.  Word choices come from ``md5(seed:id:copy)``, so
a text depends only on its id (any partitioning, any engine).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# ---------------------------------------------------------------------------
# The templates ("{}" marks the topic word) and topic words of the
# synthetic corpus, in their original order.
ZH_TEMPLATES = [
    "人工智能是{}的重要分支，致力于创建能够执行需要人类智能的任务的系统。",
    "机器学习使计算机能够从{}中学习而无需显式编程。",
    "深度学习使用{}来处理复杂的模式识别任务。",
    "自然语言处理是{}领域的重要应用方向。",
    "计算机视觉技术在{}中有广泛应用。",
    "知识图谱是{}领域的重要基础设施。",
    "向量数据库用于高效存储和检索{}。",
    "嵌入模型将文本转换为{}表示。",
    "语义搜索基于{}的相似度匹配。",
    "大语言模型在{}任务上表现出色。",
]
ZH_WORDS = [
    "计算机科学", "数据分析", "神经网络", "人工智能", "信息检索",
    "模式识别", "知识管理", "高维向量", "文本语义", "多模态学习",
    "医疗诊断", "金融分析", "自动驾驶", "智能客服", "推荐系统",
]
EN_TEMPLATES = [
    "Artificial intelligence is a branch of {} that aims to create systems capable of performing tasks requiring human intelligence.",
    "Machine learning enables computers to learn from {} without explicit programming.",
    "Deep learning uses {} to handle complex pattern recognition tasks.",
    "Natural language processing is an important application in the field of {}.",
    "Computer vision technology has wide applications in {}.",
    "Knowledge graphs are important infrastructure in the field of {}.",
    "Vector databases are used for efficient storage and retrieval of {}.",
    "Embedding models convert text into {} representations.",
    "Semantic search is based on similarity matching of {}.",
    "Large language models perform excellently on {} tasks.",
]
EN_WORDS = [
    "computer science", "data analysis", "neural networks", "artificial intelligence", "information retrieval",
    "pattern recognition", "knowledge management", "high-dimensional vectors", "text semantics", "multimodal learning",
    "medical diagnosis", "financial analysis", "autonomous driving", "intelligent customer service", "recommendation systems",
]
# ---------------------------------------------------------------------------


def synth_text(id_col, lang: str = "zh", seed: int = 42, min_length: int = 50, max_length: int = 200) -> Column:
    templates, words = (ZH_TEMPLATES, ZH_WORDS) if lang == "zh" else (EN_TEMPLATES, EN_WORDS)
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    tpl = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.pmod(i, F.lit(len(templates))) + 1).cast("int"))
    wl = F.array(*[F.lit(w) for w in words])

    def piece(rep):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), rep.cast("string")))
        w = F.element_at(wl, (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % len(words) + 1).cast("int"))
        return F.replace(tpl, F.lit("{}"), w)

    shortest = min(len(t) - 2 + min(len(w) for w in words) for t in templates)
    copies = max(1, math.ceil(min_length / (shortest + 1)) + 1)
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(copies)), piece(F.lit(0)),
                        lambda acc, r: F.when(F.length(acc) < min_length, F.concat(acc, F.lit(" "), piece(r)))
                        .otherwise(acc))
    return py_strip(F.substring(grown, 1, max_length))

"""Schemas and defaults."""

from __future__ import annotations

from dataclasses import dataclass

CONVERSATION = (
    "meta struct<name: string, type: string>, members array<struct<accountName: string>>, "
    "messages array<struct<sender: string, accountName: string, timestamp: bigint, type: int, content: string>>, _corrupt_record string"
)
MESSAGES = "conversation_key string, conversation_name string, conversation_type string, seq bigint, sender string, sender_name string, ts timestamp, content string, msg_type int"


@dataclass(frozen=True)
class Defaults:
    """Values used where a caller gives none."""

    gap_seconds: int = 30 * 60
    overlap_gap_seconds: int = 2 * 3600
    overlap_messages: int = 5
    min_messages: int = 3
    max_messages: int = 20
    max_chars: int = 200
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    content_weight: float = 0.85
    context_weight: float = 0.15
    min_relevance: float = 0.3
    batch_tokens: int = 19000
    batch_texts: int = 250


DEFAULTS = Defaults()

# Words that are no query on their own.
STOP_WORDS = ["的", "了", "我", "你", "是", "在", "有", "个", "这", "那", "就", "不", "说", "都", "也", "和", "好", "吧", "啊", "呢"]
# Code points of emoji and other pictures. The last range also holds Han, which goes too.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
# Weekday names from Monday.
WEEKDAYS = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]
# Candidate weights of the keyword score.
WEIGHTS = [0.3, 0.5, 0.7, 0.9]

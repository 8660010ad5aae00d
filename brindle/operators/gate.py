"""The inline gate: five kinds of patterns, a score, a decision. One narrow projection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import spread

# The gate's patterns (ASCII word characters, ``\b`` at ASCII word borders).
PATTERNS = {
    "phone": [
        r"(?:\+|00)\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{1,4}[\s.-]?\d{1,9}",
        r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}",
        r"\b\d{10,15}\b",
    ],
    "email": [
        r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        r"(?i)[a-zA-Z0-9._%+-]+\s*\(?at\)?\s*[a-zA-Z0-9.-]+\s*\(?dot\)?\s*[a-zA-Z]{2,}",
        r"(?i)\b[a-z]\s+[a-z]\s+[a-z].*@.*[a-z]\s+[a-z]\s+[a-z]\b",
    ],
    "url": [
        r"(?i)https?://[^\s]+",
        r"(?i)(?:www\.)[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        r"(?i)\b(?:bit\.ly|tinyurl\.com|goo\.gl|t\.co|short\.link)/[a-zA-Z0-9]+",
    ],
    "social": [
        r"(?i)\b(?:whatsapp|telegram|snapchat|snap|insta|instagram|discord|kik|signal)\b",
        r"(?i)\bDM\s+me\b",
        r"(?i)\btext\s+me\b",
        r"(?i)\bcontact\s+(?:me|us)\s+(?:at|on)\b",
    ],
    "obfuscation": [
        r"[a-zA-Z0-9]\s{2,}[a-zA-Z0-9]",
        r"(?i)\b\w+\s*\(at\)\s*\w+\s*\(dot\)\s*\w+\b",
        r"(?i)\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b",
    ],
}
# Weights, labels, texts and limits of the gate.
WEIGHTS = {"phone": 0.85, "email": 0.80, "url": 0.50, "social": 0.40, "obfuscation": 0.15}
LABELS = {"phone": "contact_info_phone", "email": "contact_info_email", "url": "external_link", "social": "social_platform_mention", "obfuscation": "obfuscation_detected"}
REASONS = {"phone": "phone number", "email": "email address", "url": "external link", "social": "social media reference"}
NUDGE_CONTACT = "Sharing personal contact information may violate platform policies and put you at risk. Please keep conversations on the platform."
NUDGE_SOCIAL = "We noticed you're trying to move the conversation off-platform. For your safety, please continue chatting here."
NUDGE_OTHER = "This message may contain content that violates our community guidelines. Please review before sending."
BLOCK_OTHER = "Message blocked due to potential policy violation"
BLOCK_ENDING = ". Keep conversations on the platform for your safety."
MAX_LENGTH, HARD_BLOCK, NUDGE = 10_000, 0.65, 0.4
#: Fixed value: white space as the patterns mean it.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
KINDS = list(PATTERNS)
#: What a text must hold for a pattern to match: one of the strings (in lower case), or a run of digits of this length.
NEEDS = {
    "phone": [["+", "00"], 3, 10],
    "email": [["@"], ["dot"], ["@"]],
    "url": [["http"], ["www."], ["/"]],
    "social": [["whatsapp", "telegram", "snap", "insta", "discord", "kik", "signal"], ["dm"], ["text"], ["contact"]],
    "obfuscation": [[], ["(at)"], []],
}


def spaced(pattern: str) -> str:
    r"""The pattern with every ``\s`` written out, inside and outside of classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        inside = (inside or c == "[") and c != "]"
        out.append(c if c != r"\s" else SPACE if inside else f"[{SPACE}]")
        i += len(c)
    return "".join(out)


def java_regex(pattern: str) -> str:
    r"""ASCII word borders: Java's ``\b`` knows Unicode letters, the gate's does not."""
    out, first = [], True
    for part in spaced(pattern).split(r"\b"):
        out.append(part)
        out.append(r"(?<![A-Za-z0-9_])" if first else r"(?![A-Za-z0-9_])")
        first = False
    return "".join(out[:-1])


def too_long(content: Column) -> Column:
    """Is the text longer than the limit, in UTF-16 units as the gate counts? Only texts near the limit are encoded."""
    n = F.length(content)
    return F.when(n > MAX_LENGTH, True).when(n * 2 <= MAX_LENGTH, False).otherwise(F.octet_length(F.encode(content, "UTF-16BE")) / 2 > MAX_LENGTH)


def _may_match(content: Column, need: list[str] | int) -> Column:
    if isinstance(need, int):
        return content.rlike(f"[0-9]{{{need}}}")
    lower = F.lower(content)
    return functools.reduce(lambda a, b: a | b, [lower.contains(x) for x in need]) if need else F.lit(True)


def found(content: Column, kind: str) -> Column:
    """Distinct trimmed strings that match any pattern of a kind, first seen first."""
    none = F.array().cast("array<string>")
    each = [F.when(_may_match(content, need), F.regexp_extract_all(content, F.lit(java_regex(p)), F.lit(0))).otherwise(none) for p, need in zip(PATTERNS[kind], NEEDS[kind], strict=True)]
    return F.array_distinct(F.transform(F.flatten(F.array(*each)), lambda x: F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")))


def with_matches(messages: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``n_<kind>`` and ``s_<kind>`` (three samples) for messages within the length limit."""
    m = spread(messages).withColumn("_m_text", F.when(~too_long(F.col(content)), F.col(content)).otherwise(F.lit("")))
    m = m.withColumns({f"_m_{k}": found(F.col("_m_text"), k) for k in KINDS})
    m = m.withColumns({f"n_{k}": F.size(f"_m_{k}") for k in KINDS} | {f"s_{k}": F.slice(f"_m_{k}", 1, 3) for k in KINDS})
    return m.drop("_m_text", *[f"_m_{k}" for k in KINDS])


def score(limit_reached: Column | None = None) -> Column:
    """max(0.85 best weight, 0.7 weighted counts) + 0.1 per further kind, at most 1."""
    zero = F.lit(0.0)
    best = F.greatest(*[F.when(F.col(f"n_{k}") > 0, F.lit(w)).otherwise(zero) for k, w in WEIGHTS.items()])
    total = zero
    for k, w in WEIGHTS.items():
        total = total + F.least(F.col(f"n_{k}"), F.lit(3)) / 3.0 * w
    kinds = sum((F.when(F.col(f"n_{k}") > 0, 1).otherwise(0) for k in KINDS), F.lit(0))
    s = F.greatest(best * 0.85, total * 0.7) + F.greatest(kinds - 1, F.lit(0)) * 0.10
    return F.when(kinds > 0, F.least(s, F.lit(1.0))).otherwise(zero)


def gate(messages: DataFrame, content: str = "content", hard_block: float = HARD_BLOCK, nudge: float = NUDGE) -> DataFrame:
    """``messages`` with risk_score, action, allowed, labels, nudge_message, block_reason.

    Null or empty content is allowed with score 0; content over the length limit is blocked
    with score 1. The limit counts UTF-16 units.
    """
    m = with_matches(messages, content)
    over, empty = too_long(F.col(content)), F.coalesce(F.col(content), F.lit("")) == ""
    m = m.withColumn("risk_score", F.when(empty, 0.0).when(over, 1.0).otherwise(score()))
    s, has = F.col("risk_score"), lambda k: F.col(f"n_{k}") > 0
    action = F.when(s >= hard_block, "hard_block").when(s >= nudge, "nudge").otherwise("allow")
    labels = F.array_compact(F.array(*[F.when(has(k), F.lit(LABELS[k])) for k in KINDS]))
    labels = F.when(over, F.array(F.lit("message_too_long"))).otherwise(labels)
    reasons = F.array_compact(F.array(*[F.when(has(k), F.lit(r)) for k, r in REASONS.items()]))
    reason = F.when(over, F.lit("Message exceeds maximum length")).when(F.size(reasons) == 0, F.lit(BLOCK_OTHER))
    reason = reason.otherwise(F.concat(F.lit("Message blocked: detected "), F.array_join(reasons, ", "), F.lit(BLOCK_ENDING)))
    text = F.when(has("phone") | has("email"), NUDGE_CONTACT).when(has("social"), NUDGE_SOCIAL).otherwise(NUDGE_OTHER)
    m = m.withColumns({"action": action, "labels": labels})
    return m.withColumns({"allowed": F.col("action") != "hard_block", "nudge_message": F.when((s >= 0.4) & (s < 0.65), text), "block_reason": F.when(F.col("action") == "hard_block", reason)})

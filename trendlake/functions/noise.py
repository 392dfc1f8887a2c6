"""Notice, advert and noise titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Titles that contain one of these are dropped, case as written (fixed values).
KEYWORDS = [
    "공지", "공지사항", "안내", "규칙", "이용규칙", "이용안내",
    "비밀번호", "권장", "필독", "운영", "운영진", "관리자",
    "점검", "서버점검", "서비스점검",
    "이벤트 안내", "당첨", "정책",
    "[공지]", "[안내]", "[필독]", "[운영]", "[이벤트]",
    "투표 참여", "설문",
    "[광고]", "[홍보]", "[협찬]", "[PR]", "[AD]",
    "리딩방", "단톡방",
    "즉시입금", "바로입금", "당일입금", "현금입금",
    "무조건", "선착순",
]

#: Titles in which one of these is found, case aside, are dropped (fixed values).
PATTERNS = [
    r"^\[공지\]",
    r"^\[안내\]",
    r"^\[필독\]",
    r"^\[운영\]",
    r"^공지[\s:]",
    r"^안내[\s:]",
    r"^AD[^a-zA-Z ]",
    r"#\S+.*#\S+",
    r"[▶▼★◆◇■□●○]{2,}",
]

SHORTEST = 6


def effective_keywords() -> list[str]:
    """The keywords that no shorter keyword implies."""
    return [k for k in KEYWORDS if not any(o != k and o in k for o in KEYWORDS)]


def effective_patterns() -> list[str]:
    """The patterns that can match a title without any keyword: those not built on one."""
    return [p for p in PATTERNS if not any(k in p.replace("\\", "") for k in effective_keywords())]


def _java(pattern: str) -> str:
    """A pattern with white space as Python sees it."""
    wide = r"\s\x{1c}-\x{1f}"
    return pattern.replace(r"[\s:]", f"[{wide}:]").replace(r"\S", f"[^{wide}]")


def is_noise(title: Column | str, folded: bool = True) -> Column:
    """Short titles, titles with a keyword, titles with a pattern. folded: the equivalent short lists."""
    t = strip(title)
    words, patterns = (effective_keywords(), effective_patterns()) if folded else (KEYWORDS, PATTERNS)
    any_word = t.rlike("|".join(re.escape(w) for w in words))
    any_pattern = F.lit(False)
    for p in patterns:
        any_pattern = any_pattern | t.rlike(f"(?idU){_java(p)}")
    return (F.length(t) < SHORTEST) | any_word | any_pattern


#: The older name of the same test.
is_notice = is_noise

"""Column functions over text; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms U+FF01..U+FF5E are the ASCII characters 0x21..0x7E moved by 0xFEE0.
_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　 "
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "


def narrow(c: Column) -> Column:
    """Full-width ASCII forms, the ideographic space and the no-break space as plain ASCII."""
    return F.translate(c, _WIDE, _NARROW)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def bare(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(narrow(c)), r"[^\p{L}\p{N}]+", "")


_LABEL = "(?:联系人|联系电话|联系地址|通讯地址|详细地址|电子邮箱|邮箱|电话|手机|联系方式)"
_GAP, _WORD = r"[\s\x1c-\x1f&&[^\n]]*", r"\p{L}\p{N}_"
CONTACT_LINE = rf"(?U)\A{_GAP}{_LABEL}{_GAP}[:：]"
#: The rest of a line after a contact label, e-mail addresses, mobile and landline numbers, in this order.
CONTACTS = [
    rf"(?U){_LABEL}{_GAP}[:：][^\n]*", rf"(?<![{_WORD}.+-])[{_WORD}.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?![{_WORD}.-])",
    r"(?<!\p{Nd})1[3-9]\p{Nd}{9}(?!\p{Nd})", r"(?<!\p{Nd})0\p{Nd}{2,3}[- ]?\p{Nd}{7,8}(?!\p{Nd})",
]


def without_contacts(c: Column) -> Column:
    """Without lines that open with a contact label; contacts elsewhere become [REDACTED]; runs of empty lines become one."""
    kept = F.array_join(F.filter(F.split(c, "\n", -1), lambda x: ~x.rlike(CONTACT_LINE)), "\n")
    for pattern in CONTACTS:
        kept = F.regexp_replace(kept, pattern, "[REDACTED]")
    return F.regexp_replace(F.trim(kept, F.lit(" \t\n")), r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")

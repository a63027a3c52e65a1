"""Sentence units of documents in any language and script, as code-point offsets.

Blank lines part blocks; list marks part items, each of which is one unit. A block's running text is
cut at gaps: runs of terminators, closing quotes after a terminator, and, in Thai, spaces. In spaced
scripts a lattice over the terminators and the words around them decides each gap: abbreviations,
initials, ordinals, decimals, ellipses and ends inside quotes or brackets are no ends. In scripts
without spaces the clauses on both sides of an unclear gap (a quote that closes after a terminator, an ellipsis, a line
break in Thai) are segmented by a dictionary word lattice: a final particle before it and an opening word
after it make it an end, a word that carries on makes it none.

A null, empty or blank text has no sentences; a text without any terminator is one sentence per block;
repeated rows give their sentences each; long texts are cut whole, in time proportional to length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence, by language, and those that may.
NEVER_END = frozenset(
    # English titles, references and units
    "dr mr mrs prof st jr no nr sec fig vol approx ca cf e.g i.e vs viz"
    # German
    " ee tsd bzw d.h z.b s.o u.a o.ä ziff str evtl ggf inkl exkl sog vgl mind bspw"
    # French and Spanish
    " mme mlle mm art p.ex ex env av éd sr sra srta dra lic ing pág pag aprox nº núm ud uds dña d art cap"
    # Russian, Hindi, Arabic
    " ok ок тыс млн млрд т.е т.к п стр рис г ул см др им д проф акад доц тел просп обл корп гл डॉ श्री प्रो أ د"
    .split()
)
#: Titles, as written; in lower case they are words or units.
TITLES = frozenset("Ms Messrs Gen Rev Hon Capt Lt Sgt Maj Gov Pres Mt MM Hr Fr Abs Abb Eq Ch".split())
MAY_END = frozenset("u.s u.k u.n p.m a.m inc ltd co corp ph.d m.d b.a m.a etc usw uu руб т.п т.д гг".split())
#: No abbreviation is longer, so a longer token is none.
LONGEST = max(map(len, NEVER_END | MAY_END)) + 8
MONTHS = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split()
)
#: Short months that stand before a day or a year.
SHORT_MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic янв фев мар апр авг сен сент окт ноя дек".split())
# Words of the lattices. Those that can open a sentence, those that carry it on, and those that close one.
OPENERS = {
    "han": "我们 你们 他们 她们 它们 咱们 大家 本岗位 该岗位 本 该 此 这 那 因此 所以 此外 另外 首先 其次 最后 如果 虽然 目前 现在 今天 之后 然后 同时"
    " 负责 参与 主导 推动 协助 独立 熟悉 了解 掌握 具备 至少 读过 理解 对 跟进 统筹 规划 持续 配合 承担 接手 牵头 深度"
    " 团队 项目 办公 提供 试用期 入职 直属 每季度 欢迎 请 同比 完成 使用 投递 什么 你 我 他 她 面试官 版本 加入 需要 要求 优先"
    " 私 私たち 弊社 当社 また さらに しかし そして それ これ この その".split(),
    "thai": "โครงการ ทีมงาน ผู้สมัคร บริษัท เรา คุณ เขา หาก ถ้า กรุณา มี ต้อง สามารถ งาน นอกจากนี้ ดังนั้น".split(),
}
CARRY_ON = {
    "han": "并请 并 随后 后 的 是 为 由 与 和 及 或 而 但 之 等 来 去 在 作为 即 则 也 都 被 把 将 给 と が は を に の で も から まで という といった って です".split(),
    "thai": "และ หรือ ที่ ซึ่ง ของ ใน ให้ แต่ เพื่อ โดย".split(),
}
FINALS = {
    "han": "了 吗 呢 吧 啊 呀 嘛 哦 啦 罢了 而已 です ます でした ました ません だ ね よ か なさい".split(),
    "thai": "ครับ ค่ะ คะ นะ จ้ะ แล้ว ไหม เลย".split(),
}
LEXICON = {script: frozenset(OPENERS[script]) | frozenset(CARRY_ON[script]) | frozenset(FINALS[script]) for script in OPENERS}
LONGEST_WORD = {script: max(map(len, words_)) for script, words_ in LEXICON.items()}
CLOSERS_OF = {"”": "“„", "“": "„", "」": "「", "』": "『", ")": "(（", "）": "(（", "]": "[", "】": "【", "》": "《", "»": "«"}
OPENS = frozenset("“「『(（[【《«„")
HARD = frozenset("。！？｡।؟॥！？")
TERMS = re.compile(r"[。！？｡।؟॥.．!?…]+")
MARK = re.compile(r"[^\S\n]*(?:(?P<p>[（(])(?P<n1>\d{1,3})[)）]|(?P<n2>\d{1,3})(?P<d>[.．)、])(?=\s|[^\d\s.])|(?P<c>[①-⑳])|(?P<b>[-*•·●▪‣–—])(?=[^\S\n]))")
TAG = re.compile(r"(?:</[a-zA-Z]{1,10}>)+")
HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
THAI = re.compile(r"[฀-๿]")


def words(text: str, script: str) -> list[str]:
    """The best path through the lattice of dictionary words over ``text``: fewest pieces, single
    characters that are in no word costing a little more than a word."""
    lexicon, longest = LEXICON[script], LONGEST_WORD[script]
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * len(text)
    for i in range(len(text)):
        for n in range(1, min(longest, len(text) - i) + 1):
            known = text[i : i + n] in lexicon
            if n > 1 and not known:
                continue
            cost = best[i][0] + (1.0 if known else 1.2)
            if cost < best[i + n][0]:
                best[i + n] = (cost, i)
    out, i = [], len(text)
    while i:
        out.append(text[best[i][1] : i])
        i = best[i][1]
    return out[::-1]


#: What bounds a clause.
BREAK = re.compile(r"[\s。！？｡!?…，,、；;：:“”「」『』\"()（）]")
CLAUSE = re.compile(r"[^\s。！？｡!?…，,、；;：:“”「」『』\"()（）]*")


def opens(text: str, at: int, script: str) -> bool | None:
    """Whether the clause at an offset starts a sentence: by the first word of its lattice; None if that says nothing."""
    first = next(iter(words(CLAUSE.match(text, at)[0], script)), "")
    return True if first in OPENERS[script] else False if first in CARRY_ON[script] else None


def closes(text: str, at: int, script: str) -> bool:
    """Whether the clause that ends at an offset ends in a final particle."""
    begin = at
    while begin and not BREAK.match(text[begin - 1]):
        begin -= 1
    return next(reversed(words(text[begin:at], script)), "") in FINALS[script]


def spans(text: str) -> list[tuple[int, int]]:
    """The outermost matched pairs of quotes and brackets."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    pairs = []

    def close(openers: str, i: int) -> None:
        # What is above the opener was never closed; each is taken off once.
        while True:
            o, at = stack.pop()
            held[o] -= 1
            if o in openers:
                pairs.append((at, i))
                return

    for i, ch in enumerate(text):
        if ch == '"' and held.get('"'):
            close('"', i)
        elif ch in CLOSERS_OF and any(held.get(o) for o in CLOSERS_OF[ch]):
            close(CLOSERS_OF[ch], i)
        elif ch in OPENS or ch == '"':
            stack.append((ch, i))
            held[ch] = held.get(ch, 0) + 1
    outer: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


SPACE, WORD, LETTERS = re.compile(r"\s*"), re.compile(r"[^\s.,;:!?]*"), re.compile(r"\w*")


def token_before(text: str, at: int) -> str:
    """The run without white space that ends at an offset, or its last LONGEST characters."""
    begin = at
    while begin and at - begin < LONGEST and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:at]


def ends_at_dot(text: str, a: int, b: int) -> bool:
    """Whether the full stop text[a:b], outside quotes, ends a sentence: the lattice of what it may be (a mark of an
    abbreviation, an initial, an ordinal, a month, or an end), decided by the tokens on both sides. Closing tags between are passed over."""
    before = text[a - 1 : a]
    tag = TAG.match(text, b)
    at = tag.end() if tag else b
    after = text[at : at + 1]
    if not after:
        return True
    if not after.isspace():
        if after == "<" and not tag:
            return False
        if HAN.match(before):
            return bool(HAN.match(after)) or after.isupper() or after in '“「《【"（('
        return bool(HAN.match(after)) and before.isalnum() and not text[:a].strip().isdigit()
    if HAN.match(before):
        return True
    token = token_before(text, a)
    token = token.lstrip("(（[“\"«„'’¿¡")
    low = token.lower()
    low = re.sub(r"^(?:l|d|qu)['’]", "", low)
    rest = SPACE.match(text, at).end()
    word = WORD.match(text, rest)[0]
    if rest == len(text):
        return True
    if low in NEVER_END or token in TITLES or (len(low) == 1 and low.isalpha()):
        return False
    if low in MAY_END:
        return word[:1].isupper() and word[1:2].islower()
    if (low.isdigit() and word.lower() in MONTHS) or (low in SHORT_MONTHS and word[:1].isdigit()):
        return False
    return True


def cut(text: str, thai: bool) -> list[int]:
    """The offsets after which the sentences of one paragraph end."""
    pairs = spans(text)
    ends: set[int] = set()
    at = 0
    for m in TERMS.finditer(text):
        a, b = m.span()
        while at < len(pairs) and pairs[at][1] < a:
            at += 1
        if at < len(pairs) and pairs[at][0] < a < pairs[at][1]:
            continue
        run, before, after = m[0], text[a - 1 : a], text[b : b + 1]
        plain = run.replace("．", ".")
        if set(run) <= {"…"}:
            # An ellipsis within a sentence does not end it; one between a final particle and an opening word does.
            if HAN.match(before) and closes(text, a, "han") and opens(text, b, "han"):
                ends.add(b)
            continue
        if set(plain) == {"."}:
            if len(plain) > 1:
                rest = SPACE.match(text, b).end()
                good = after.isspace() and text[rest : rest + 1].isupper() and not before.isspace()
            elif run == "．" and after.isdigit():
                good = False
            else:
                good = ends_at_dot(text, a, b)
        elif set(run) & HARD:
            good = True
        else:
            good = not after or after.isspace() or after == "<" or bool(HAN.match(after)) or after in OPENS or (bool(HAN.match(before)) and not after.isdigit())
        if good:
            tag = TAG.match(text, b)
            ends.add(tag.end() if tag else b)
    for a, b in pairs:
        inner = text[a + 1 : b].rstrip()
        if not inner or inner[-1] not in "。！？｡।؟.!?．" or b + 1 >= len(text):
            continue
        at = SPACE.match(text, b + 1).end()
        gap = text[b + 1 : at]
        if at == len(text):
            continue
        ch = text[at]
        if HAN.match(ch):
            first = opens(text, at, "han")
            good = bool(gap) and "\n" not in gap and first is not False or (not gap and first is True and a > 0 and text[a - 1] in "：:")
            good = good and not text[a] in "(（"
        else:
            word = LETTERS.match(text, at)[0]
            shout = len(word) > 1 and word.isupper()
            good = bool(gap) and (ch.isupper() and not shout or ch in OPENS or ch in '¿¡"')
        if good:
            ends.add(b + 1)
    if thai:
        for m in re.finditer(r"\s+", text):
            a, b = m.span()
            if a == 0 or b == len(text) or any(p < a < q for p, q in pairs):
                continue
            if "\n" in m[0] and not opens(text, b, "thai") and not (closes(text, a, "thai") and opens(text, b, "thai") is None):
                continue
            ends.add(a)
    return sorted(ends | {len(text)})


def units(text: str) -> list[tuple[int, int, bool]]:
    """The paragraphs and list items of a text, as spans, and whether each is an item."""
    out: list[tuple[int, int, bool]] = []
    start: int | None = None
    item = False
    last: tuple[str, int] | None = None
    stop = 0
    for m in re.finditer(r"[^\n]*\n?", text):
        line = m[0]
        if not line:
            continue
        if not line.strip():
            if start is not None:
                out.append((start, stop, item))
            start, last = None, None
            continue
        mark = MARK.match(line)
        if mark:
            kind = mark["p"] or mark["d"] or mark["b"] or "c"
            kind = {"（": "(", "．": "."}.get(kind, kind)
            number = int(mark["n1"] or mark["n2"] or (ord(mark["c"]) - 0x245F if mark["c"] else 0))
            follows = last is not None and last[0] == kind and number in (last[1] + 1, 0)
            begins = last is None and number <= 1 and (kind != "-" or text[:stop].rstrip()[-1:] in "。！？.!?:：")
            if start is None or follows or (begins and not (kind in "–—")):
                if start is not None:
                    out.append((start, stop, item))
                start, item, last = m.start(), True, (kind, number)
                stop = m.end()
                continue
        if start is None:
            start, item = m.start(), False
        stop = m.end()
    if start is not None:
        out.append((start, stop, item))
    return out


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, end exclusive, without surrounding white space."""
    if not text:
        return []
    found = []
    for a, b, item in units(text):
        part = text[a:b]
        ends = [len(part)] if item else cut(part, 3 * len(THAI.findall(part)) > len(part))
        begin = 0
        for end in ends:
            piece = part[begin:end]
            body = piece.strip()
            if body:
                s = a + begin + len(piece) - len(piece.lstrip())
                found.append((s, s + len(body)))
            begin = end
    return found


def segment(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, e) for d, t in zip(b["doc_id"], b["text"]) for s, e in sentences(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id bigint, start_char bigint, end_char bigint")

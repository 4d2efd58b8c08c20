"""Problem 8: sentences of texts in many languages and scripts.

A linear-chain model tags each character as boundary or inside and is decoded with Viterbi; characters that no mark,
blank or learned gap makes a possible end are inside by construction. All weights, of what a place looks like and of
neighbouring tags, are trained by averaged structured perceptrons on all documents and on a few lines that are labelled
here: one for each shard of the documents, of which the model is the mean. Labels come from places that need no judging (ends of paragraphs, marks before a small
letter, marks inside a quotation) and, for stops, from what stands before and after the stops that end paragraphs
against all stops; places that stay in doubt carry no label and are filled in by the model as it learns. For scripts
without marks the model is trained on text whose marks are stripped: the letters around a blank in Thai and its like,
the letters around every gap in stretches without any mark or blank.
"""

from __future__ import annotations

import math
import pickle
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.lookalike import LOOKALIKES
from paperlode.llm.patterns import rx
from paperlode.session import cut_lineage, spread

#: Characters of the documents of a shard, about, and rounds of training.
SHARD_CHARS, ROUNDS = 2_000_000, 4
MIN_WRAP, SMOOTH = 28, 0.2
#: By so much the weight that all gaps share moves for each that is wrong.
GAP_STEP = 7
#: A stop is taken for an end, or for none, in training where the log evidence is above the first or below the second.
SURE_END, SURE_INSIDE = -1.0, -3.0
#: Closing marks by their opening mark.
CLOSERS = {"(": ")", "[": "]", "{": "}", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "「": "」", "『": "』", "“": "”", "«": "»", "„": "“", "‹": "›", '"': '"'}
QUOTES = set("“”«»„「」『』\"‹›")
#: Words before a stop that seldom end a sentence; the weight of being one of them is learned.
TITLES = "mr mrs ms dr prof messrs st no nos fig sect cf vs approx dept pref abs art nr bzw ca sr sra dra mme p pp vol д г п т е ул стр с डॉ श्री د أ บมจ บจ".split()
STRONG = set("!?。؟।॥።។")
GO_ON = set(",;:、，；：—–-)]】》")
_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0xFF61: "。", 0x3000: " ", 0xFF64: "、"}
_INVISIBLE = regex.compile(r"\p{Cf}")
_LINE = regex.compile(r"\r\n|\n|\r| | |\u0085")
_MARKS = regex.compile(r"[.!?。؟।॥…።។]+(?:[   ]?[!?]+)*(?:[   ]?[»›]|[”\"’」』)\]》】“])*")
_TOKEN_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.'’&\-]{0,24}$")
_TOKEN_AFTER = regex.compile(r"[\p{L}\p{M}\p{N}]{1,24}|[^\s\p{L}\p{N}]")
_PAIR = regex.compile(r"[()\[\]{}《》〈〉【】〔〕「」『』“”«»„‹›\"]")
_TOKEN_WRAPPED = regex.compile(r"[^\s\p{Han}\p{Hiragana}\p{Katakana}]+|(?s:.)")
_LIST_NUMBER = regex.compile(r"\s*\(?\d{1,3}$")
_FOLD = str.maketrans(LOOKALIKES)
_UNMARKED = regex.compile(r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF]")
_WIDE = regex.compile(f"[{''.join(map(chr, _WIDTH))}]")
#: Labelled lines, a bar after each sentence but the last. They speak for usage that small corpora lack.
LABELLED = (
    "Dr. Hale signed the deed.|Prof. A. Lindt et al. agreed with Mr. Ito.|See No. 7 and Fig. 3.|What now?|It cost RMB 4.1m in all!|The fee was paid.",
    "“Hold on!” was the motto.|The trustee warned: “Redeem early!”|Nobody did.|“Why?” asked the clerk.|The U.S. Treasury replied.|So it went...|Then it stopped.",
    "Die Prüfung ergab: „Keine Mängel.“|Das kostet ca. 3 €!|Vgl. Art. 5 Abs. 2 des Gesetzes.|Herr Dr. Braun widersprach.|Es gilt Nr. 12.",
    "« Faut-il corriger ? » demanda l’auditeur.|M. Petit refusa.|Aucun dividende !|Voir art. 4.|Le prix reste stable.",
    "El Sr. Gil firmó el acta.|La Dra. Paz no.|¿Quién paga?|Nadie respondió.|Véase el art. 9.",
    "«Будет ли выкуп?» — спросил аудитор.|Дивидендов не будет!|См. стр. 5 и ул. Мира.|Совет утвердил план.|В 2020 г. Банк закрылся.",
    "“我们不会降价。”负责人重申。|他写道：“请参阅附录。”|本期净利润为5.4亿元。|谁来承担？！|董事会通过了该议案.|其余不变。|已用41.3%……其余未动用。",
    "口号是“坚持！创新！”，写在墙上。|“谁负责？？”——没有人回答。|《何时退保？》一文已经发表。|会议（详见附注。另有说明）照常举行。|“同意！”、“反对！”都有人喊。|公司称“暂无计划。”；监管未予置评。",
    "“Stop!”, they cried.|“Who pays?” — nobody knew.|He asked (why not?) and left.|„Halt!“, rief er.|« Non ! », dit-elle.|«Нет!», — ответил он.|Yahoo! was sold.|Approx. 5 kg were lost; the rest vs. stock is fine.",
    "監査人は「問題はない。」と述べた。|配当は見送られました！|「開始します。」|次は何か？|以上です。",
    "“해지가 가능합니까?”라고 계약자가 물었다.|배당은 없다.|금리는 4%이다!|이사회가 승인했다.|다음은 무엇인가?",
    "कोई लाभांश नहीं!|ब्याज दर 4% है।|डॉ. राव ने हस्ताक्षर किए।|क्या शुल्क देय है?|बैठक समाप्त हुई।",
)


def _cjk(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "\U00020000" <= ch <= "\U0003ffff"


def _thai(ch: str) -> bool:
    return "฀" <= ch <= "໿" or "က" <= ch <= "႟" or "ក" <= ch <= "៿"


def cleaned(text: str) -> tuple[str, np.ndarray | None]:
    """The text without invisible characters and with narrow forms, and the place of each character in the text."""
    if _WIDE.search(text):
        text = text.translate(_WIDTH)
    if not _INVISIBLE.search(text):
        return text, None
    keep = [i for i, ch in enumerate(text) if not _INVISIBLE.match(ch)]
    return "".join(text[i] for i in keep), np.array(keep, dtype=np.int64)


def runs(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, paragraph ends here) of stretches that no sentence crosses.

    A line break inside a block of lines only fits the width if the block is at least MIN_WRAP wide, the first
    word of the next line would not have fitted, and so it is with half of its lines; others end a stretch.
    """
    lines, at = [], 0
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))
    blank = [not text[a:b].strip() for a, b in lines]
    size = [len(text[a:b].rstrip()) for a, b in lines]
    wide: list[int] = [0] * len(lines)
    first = 0
    for i in range(len(lines)):  # the width to which the lines of a block are filled
        if blank[i]:
            first = i + 1
        elif i + 1 == len(lines) or blank[i + 1]:
            wide[first:i] = [max(size[first:i], default=0)] * (i - first)

    def full(i: int) -> bool:
        a, b = lines[i + 1]
        if wide[i] < MIN_WRAP or text[a] in " \t":
            return False
        word = 0 if _cjk(text[a]) else len(_TOKEN_WRAPPED.match(text, a, b)[0]) + (not _cjk(text[max(lines[i][1] - 1, 0)]))
        return size[i] + word >= wide[i] - _cjk(text[a])

    goes_on = [i + 1 < len(lines) and not blank[i] and not blank[i + 1] for i in range(len(lines))]
    fits = [goes_on[i] and full(i) for i in range(len(lines))]
    first = 0
    for i in range(len(lines)):
        if not goes_on[i]:  # a block in which few lines are full is a list
            if sum(fits[first:i]) < 0.5 * (i - first):
                fits[first:i] = [False] * (i - first)
            first = i + 1
    for i in range(len(lines)):  # an open line before a small letter, or after a comma, goes on whatever its width
        if goes_on[i] and not fits[i] and size[i]:
            last, head = text[lines[i][0] + size[i] - 1], text[lines[i + 1][0] : lines[i + 1][1]].lstrip()[:1]
            fits[i] = (head.islower() and last not in ".!?。:") or last in ",、，;；"
    out, start = [], None
    for i, (a, b) in enumerate(lines):
        if blank[i]:
            continue
        start = a if start is None else start
        if not fits[i]:
            out.append((start, b, not goes_on[i]))
            start = None
    return out


def before(text: str, end: int) -> list[str]:
    """What stands before a place: the word with digits as 0, or the last letters where the script has no blanks."""
    if end and _thai(text[end - 1]):
        return [text[max(0, end - n) : end] for n in (2, 4, 7)]
    word = _TOKEN_BEFORE.search(text, max(0, end - 24), end)[0].strip(".'’-")
    word = (word if word.isascii() else word.translate(_FOLD)).lower()
    return [rx(r"\d").sub("0", word) or text[max(0, end - 1) : end]]


def after(text: str, start: int) -> list[str]:
    if start < len(text) and _thai(text[start]):
        return [text[start : start + n] for n in (2, 4, 7)]
    word = _TOKEN_AFTER.match(text, start)
    text = word[0] if word else ""
    return [rx(r"\d").sub("0", text if text.isascii() else text.translate(_FOLD))]


def places(text: str, a: int, b: int) -> list[tuple[int, int, str, int]]:
    """(end, start of what follows, kind, opening quote or -1) of the places in a stretch where a sentence may end.

    Kinds: strong (a mark that only ends sentences), stop (one with other uses), dots (left open), blank (a blank
    in a script without marks).
    """
    part = text[a:b]
    opens, depth_from, partner = [], [], {}
    spans = []
    if _PAIR.search(part):
        for m in _PAIR.finditer(part):
            ch = m[0]
            if opens and CLOSERS[opens[-1][0]] == ch:
                o = opens.pop()
                spans.append((o[1], m.start()))
                partner[m.start()] = o[1]
            elif ch in CLOSERS:
                opens.append((ch, m.start()))
            else:  # a closing mark that skips openings left open
                for k in range(len(opens) - 1, -1, -1):
                    if CLOSERS[opens[k][0]] == ch:
                        spans.append((opens[k][1], m.start()))
                        partner[m.start()] = opens[k][1]
                        del opens[k:]
                        break
        spans.sort()
    merged: list[list[int]] = []
    for s, e in spans:
        if not merged or s > merged[-1][1]:
            merged.append([s, e])
        else:
            merged[-1][1] = max(merged[-1][1], e)
    starts = [s for s, _ in merged]
    found = []
    size = len(part)
    for m in _MARKS.finditer(part):
        marks_end = m.start()
        while marks_end < m.end() and part[marks_end] in ".!?。؟।॥…።។   ":
            marks_end += 1
        end = m.end()
        while end > marks_end and end - 1 not in partner:  # an opening mark, or one without partner
            end -= 1
        while end > m.start() and part[end - 1] in "   ":
            end -= 1
        k = bisect_right(starts, end - 1) - 1
        if k >= 0 and merged[k][0] < end - 1 < merged[k][1] or k >= 0 and merged[k][0] < m.start() <= merged[k][1] and end <= merged[k][1]:
            continue
        nxt = end
        while nxt < size and part[nxt].isspace():
            nxt += 1
        if end - 1 in partner and part[end - 1] not in QUOTES and nxt < size:
            continue  # inside brackets or a title
        quote = partner[end - 1] if end - 1 in partner and part[end - 1] in QUOTES else -1
        marks = m[0]
        if not STRONG.isdisjoint(marks):
            kind = "strong"
        elif "…" in marks or "..." in marks:
            kind = "dots"
        else:
            kind = "stop"
        spaced = nxt > end or nxt >= size
        if kind == "stop" and not spaced:
            behind = part[m.start() - 1] if m.start() else ""
            if not (behind and _cjk(behind) and (_cjk(part[nxt]) or part[nxt] in "“《「（(")):
                continue
        if kind == "strong" and not spaced and not (_cjk(part[nxt]) or _cjk(part[m.start() - 1 : m.start()] or " ") or part[nxt] in CLOSERS or quote >= 0 or "。" in marks or "।" in marks):
            continue
        if kind == "stop" and _LIST_NUMBER.match(part, 0, m.start()) and _LIST_NUMBER.match(part, 0, m.start()).end() == m.start():
            continue  # the number that heads a paragraph
        found.append((a + end, a + nxt, kind, a + quote if quote >= 0 else -1))
    if _UNMARKED.search(part):
        if len(_UNMARKED.findall(part)) * 3 > sum(map(str.isalpha, part)):
            ends = {x[0] for x in found}
            for m in rx(r"\s+").finditer(part):
                k = bisect_right(starts, m.start()) - 1
                if 0 < m.start() and m.end() < size and a + m.start() not in ends and not (k >= 0 and merged[k][0] < m.start() < merged[k][1]):
                    found.append((a + m.start(), a + m.end(), "blank", -1))
            found = [x for x in found if x[2] != "stop" or x[1] >= b]
            found.sort()
    return found


class Place(NamedTuple):
    """What the model sees of a place where a sentence may end."""

    kind: str
    mark: str  # the mark and what kind of character stands before it
    follow: str  # what kind of character comes next
    spaced: str  # what lies between: nothing, a blank or the end of a line
    quoted: bool  # the mark closes a quotation
    opened: bool  # with which the sentence may have begun
    hollow: bool  # there is no letter or digit since the last place
    behind: tuple[str, ...]
    ahead: tuple[str, ...]


def character(ch: str) -> str:
    if not ch:
        return "end"
    if ch in GO_ON:
        return "go_on"
    if ch in "」』”»":
        return "close"
    if ch in "“《「『（(«„‹[{【\"":
        return "open"
    if "가" <= ch <= "힣":
        return "hangul"
    if _cjk(ch):
        return "cjk"
    if ch.isdigit():
        return "digit"
    return "lower" if ch.islower() else "upper" if ch.isupper() else "letter" if ch.isalpha() else "other"


def described(text: str, a: int, b: int) -> list[tuple[int, Place]]:
    """(end, what the model sees) of the places of a stretch."""
    out, since = [], a + len(text[a:b]) - len(text[a:b].lstrip())
    for end, start, kind, quote in places(text, a, b):
        follow = character(text[start]) if start < b else "end"
        if quote >= 0 and (text.startswith("って", start) or text.startswith("と", start)):
            follow = "said"
        stop = end
        while kind != "blank" and stop and text[stop - 1] in ".!?。؟।॥…።។”\"»’)“」』 ":
            stop -= 1
        words = kind in ("stop", "blank") and follow != "end"
        behind, ahead = (tuple(before(text, stop)), tuple(after(text, start))) if words else ((), ())
        opened = quote >= 0 and not text[since:quote].strip()
        hollow = not any(map(str.isalnum, text[since:end]))
        gap = "" if start == end else "line" if "\n" in text[end:start] or "\r" in text[end:start] else "blank"
        mark = "" if kind == "blank" else text[stop : stop + 1] + character(text[stop - 1 : stop])
        out.append((end, Place(kind, mark, follow, gap, quote >= 0, opened, hollow, behind, ahead)))
        since = start
    return out


def gaps(text: str, a: int, b: int) -> list[tuple[int, Place]]:
    """Every gap between two letters of a stretch without marks, as a place."""
    found = []
    for i in range(a + 1, b):
        ahead = tuple(text[i : i + n] for n in (1, 2, 3))
        found.append((i, Place("gap", "", "", "", False, False, False, tuple(text[max(a, i - n) : i] for n in (1, 2, 3)), ahead)))
    return found


def features(x: Place, evidence: dict[str, float]) -> list[str]:
    """What a place shows, each of which has a weight."""
    out = [x.kind, f"{x.kind} {x.follow}", f"{x.kind} {x.mark}", f"{x.kind} {x.mark} {x.follow} {x.spaced}", f"{x.kind} {x.follow} {x.spaced} {x.quoted} {x.opened}"]
    if x.quoted:
        out.append(f"quoted {x.follow} {x.spaced != ''}")
    if x.opened:
        out.append(f"opened {x.follow} {x.spaced != ''}")
    if x.hollow:
        out.append("hollow")
    if x.kind == "gap":
        return out + [f"<{w}" for w in x.behind] + [f">{w}" for w in x.ahead]
    if x.behind:
        out += [f"{x.kind} <{w}" for w in x.behind] + [f"{x.kind} >{w}" for w in x.ahead]
        out.append(f"{x.kind} evidence {round(2 * told(x, evidence))}")
        if x.kind == "stop":
            out.append(f"length {min(len(x.behind[0]), 4)} {x.behind[0].isalpha()} {x.follow}")
            out.append(f"title {x.behind[0] in TITLES}")
    return out


def told(x: Place, evidence: dict[str, float]) -> float:
    """Log evidence for an end by what stands before and after a place, each the mean of its tokens."""
    mean = lambda side, words: sum(evidence.get(f"{x.kind}{side}{w}", 0.0) for w in words) / max(len(words), 1)
    ahead = mean(">", x.ahead)
    if x.mark.endswith("letter") and x.follow == "upper":
        ahead = max(ahead, -1.0)  # a name in another script says little
    return mean("<", x.behind) + ahead


def label(x: Place, evidence: dict[str, float]) -> int | None:
    """Boundary or inside where that needs no judging; None in doubt."""
    if x.follow == "end":
        return 1
    if x.hollow or x.follow in ("go_on", "close") or x.quoted and (x.follow in ("lower", "said") or x.follow == "hangul" and not x.spaced):
        return 0
    if x.opened and not (x.follow == "upper" and x.spaced):
        return 0
    if x.kind == "dots":
        return int(x.follow == "upper" and x.spaced)
    if x.kind == "strong":
        return None if x.follow == "lower" else 1
    if x.kind == "stop":
        if x.follow == "lower" or x.follow == x.mark[1:] == "digit" and x.spaced == "line":
            return 0  # a number may go on in the next line
        if x.mark.endswith("cjk") or x.quoted:
            return 1
        if x.behind[0] in TITLES or len(x.behind[0]) == 1 and x.behind[0].isalpha():
            return 0 if told(x, evidence) < SURE_END else None
    sure = told(x, evidence)
    return 1 if sure > SURE_END else 0 if sure < SURE_INSIDE else None


def examples(raw: str) -> tuple[list[list[Place]], list[Place], list[str]]:
    """(places by stretch, places between paragraphs, stretches of several sentences in scripts without blanks) of a text."""
    text, _ = cleaned(raw)
    inside, between, plain = [], [], []
    stretches = runs(text)
    for n, (a, b, paragraph) in enumerate(stretches):
        inside.append([x for _, x in described(text, a, b)])
        if _cjk(text[a]) and len(rx(r"[。！？]").findall(text[a:b])) > 1:
            plain.append(text[a:b])
        if not paragraph or n + 1 == len(stretches):
            continue
        last, first = len(text[:b].rstrip()) if text[b - 1 : b].isspace() else b, stretches[n + 1][0]
        mark = text[last - 1 : last]
        kind = "stop" if mark == "." else "strong" if mark in "!?。؟।" else "blank" if _UNMARKED.match(mark) else ""
        if kind:
            first += len(text[first : stretches[n + 1][1]]) - len(text[first : stretches[n + 1][1]].lstrip())
            stop = last - (kind != "blank")
            seen = "" if kind == "blank" else mark + character(text[stop - 1 : stop])
            words = (tuple(before(text, stop)), tuple(after(text, first))) if kind != "strong" else ((), ())
            between.append(Place(kind, seen, character(text[first : first + 1]), "" if _cjk(text[first]) else "blank", False, False, False, *words))
    return inside, between, plain


def counts_of(inside: list[list[Place]], between: list[Place]) -> Counter[str]:
    """How often each word stands among the ends of paragraphs (k) and among all places of its kind (e), and their totals."""
    counts: Counter[str] = Counter()
    for name, rows in (("k", between), ("e", [x for seq in inside for x in seq if x.follow != "end"])):
        for x in rows:
            if x.behind:
                counts.update([f"{name}={x.kind}"] + [f"{name}:{x.kind}<{w}" for w in x.behind] + [f"{name}:{x.kind}>{w}" for w in x.ahead])
    return counts


def evidence_of(counts: dict[str, int]) -> dict[str, float]:
    """Log of the share of each word among the ends of paragraphs over its share among all places of the kind."""
    out = {}
    for key in {k[2:] for k in counts if k[1] == ":"}:
        kind = key[: key.index("<" if "<" in key[:6] else ">")]
        e, o = counts.get(f"k={kind}", 0) + 1, counts.get(f"e={kind}", 0) + 1
        out[key] = min(3.0, max(-8.0, math.log((counts.get(f"k:{key}", 0) + SMOOTH) / e) - math.log((counts.get(f"e:{key}", 0) + SMOOTH) / o)))
    return out


def stripped(part: str) -> tuple[str, np.ndarray]:
    """A stretch without its marks, and for every gap of it 1 where a mark that ends a sentence stood."""
    text, ends = "", []
    for piece in rx(r"[。！？]+[”」』]*").split(part):
        text += rx(r"[^\p{L}\p{N}]").sub("", piece)
        ends.append(len(text))
    tags = np.zeros(max(len(text) - 1, 0), dtype=np.int64)
    tags[[e - 1 for e in ends if 0 < e < len(text)]] = 1
    return text, tags


def grams(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """The distinct features of the letters around all gaps of texts, as of `features`, and for each text their numbers, six for a gap."""
    keys = [np.zeros((0, 6), dtype=np.uint64)]
    for text in texts:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n, i = len(cp), np.arange(1, len(cp))
        width = np.uint64(21)
        behind = [cp[i - 1]]
        ahead = [cp[i]]
        for k in (1, 2):  # shorter at the ends of the text
            behind.append(np.where(i > k, cp[np.maximum(i - k - 1, 0)] << np.uint64(21 * k) | behind[-1], behind[-1]))
            ahead.append(np.where(i + k < n, ahead[-1] << width | cp[np.minimum(i + k, n - 1)], ahead[-1]))
        keys.append(np.stack([*behind, *(x | np.uint64(1 << 63) for x in ahead)], axis=1))
    every, number = np.unique(np.concatenate(keys), return_inverse=True)
    names = ["<>"[key >> 63] + "".join(chr(c) for c in (key >> 42 & 0x1FFFFF, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c) for key in every.tolist()]
    return names, np.split(number.reshape(-1, 6), np.cumsum([len(k) for k in keys[1:]])[:-1]) if texts else []


class Model:
    """Weights of a linear chain over boundary and inside. Scores of places are kept, as most places look like others."""

    def __init__(self, weights: dict[str, float], steps: dict[bool, list[float]], evidence: dict[str, float], longest: int):
        self.weights, self.steps, self.evidence, self.longest, self.known = weights, steps, evidence, longest, {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def score(self, x: Place) -> float:
        found = self.known.get(x)
        if found is None:
            found = sum(self.weights.get(f, 0.0) for f in features(x, self.evidence))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[x] = found
        return found


def viterbi(scores: list[float], steps: tuple[float, ...] | list[float], fixed: list[int | None] | None = None) -> list[int]:
    """The best tags of a chain: scores speak for a boundary, steps for (before, here) as 00, 01, 10, 11; fixed tags are kept."""
    inside, bound, back = 0.0, -1e9, []  # what comes before a stretch counts as inside
    for i, here in enumerate(scores):
        want = fixed[i] if fixed else None
        i0, i1 = inside + steps[0], bound + steps[2]
        b0, b1 = inside + steps[1] + here, bound + steps[3] + here
        back.append((i1 > i0, b1 > b0))
        inside, bound = (-1e9 if want == 1 else max(i0, i1)), (-1e9 if want == 0 else max(b0, b1))
    tag, tags = int(bound > inside), []
    for came in reversed(back):
        tags.append(tag)
        tag = int(came[tag])
    return tags[::-1]


def fitted(texts: list[tuple[list[list[Place]], list[Place], list[str]]], evidence: dict[str, float]) -> dict[str, float]:
    """Weights by feature, and of steps, of the examples of texts and of the labelled lines, by an averaged perceptron over whole stretches."""
    texts = [*texts, *(examples(line.replace("|", "\n\n")) for line in LABELLED)]
    inside, between = [seq for x, _, _ in texts for seq in x if seq], [p for _, x, _ in texts for p in x]
    chains = [(seq, [label(x, evidence) for x in seq]) for seq in inside] + [([x], [1]) for x in between]
    for line in LABELLED:
        parts, joined = line.split("|"), line.replace("|", "" if _cjk(line[0]) else " ")
        ends = {sum(len(p) + (not _cjk(line[0])) for p in parts[: n + 1]) - (not _cjk(line[0])) for n in range(len(parts))}
        spots = described(joined, 0, len(joined))
        chains += [([x for _, x in spots], [int(end in ends) for end, _ in spots])] * 3
    plain = [x for _, _, own in texts for x in map(stripped, own) if len(x[1])]
    names, codes = grams([text for text, _ in plain])
    number: dict[str, int] = {}
    seen: dict[Place, list[int]] = {}

    def of(x: Place) -> list[int]:
        if x not in seen:
            seen[x] = [number.setdefault(f, len(number)) for f in features(x, evidence)]
        return seen[x]

    rows = [([of(x) for x in seq], tags) for seq, tags in chains]
    w, late, at = [0.0] * len(number), [0.0] * len(number), 1
    of_gap, gap_late = np.zeros(len(names) + 1), np.zeros(len(names) + 1)  # the last is that of every gap
    steps, steps_late = {True: np.zeros(4), False: np.zeros(4)}, {True: np.zeros(4), False: np.zeros(4)}  # of gaps, of other places
    before_of = lambda tags: np.concatenate([[0], tags[:-1]])
    order = np.random.default_rng(3)
    for _ in range(ROUNDS):
        for n in order.permutation(len(rows) + len(plain)):
            gap = n >= len(rows)
            if gap:
                mine, gold = codes[n - len(rows)], plain[n - len(rows)][1]
                got = np.array(viterbi((of_gap[mine].sum(axis=1) + of_gap[-1]).tolist(), steps[True].tolist()))
                wrong = np.flatnonzero(gold != got)
                if len(wrong):
                    d = (gold - got)[wrong]
                    for sums, by in ((of_gap, 1), (gap_late, at)):
                        np.add.at(sums, mine[wrong], d[:, None] * float(by))
                        sums[-1] += GAP_STEP * d.sum() * by
            else:
                seq, tags = rows[n]
                scores, now = [sum([w[f] for f in fs]) for fs in seq], steps[False].tolist()
                got = viterbi(scores, now)
                wrong = not all(t is None or t == g for t, g in zip(tags, got))
                if wrong:
                    gold = viterbi(scores, now, tags)
                    for fs, g, h in zip(seq, gold, got):
                        if g != h:
                            for f in fs:
                                w[f] += g - h
                                late[f] += (g - h) * at
                    gold, got = np.array(gold), np.array(got)
            if gap and len(wrong) or not gap and wrong:
                d = np.bincount(2 * before_of(gold) + gold, minlength=4) - np.bincount(2 * before_of(got) + got, minlength=4)
                steps[gap] += d
                steps_late[gap] += d * at
            at += 1
    out = {f: x - y / at for f, x, y in zip(number, w, late) if x or y}
    out |= {f: x - y / at for f, x, y in zip([*names, "gap"], of_gap.tolist(), gap_late.tolist()) if x or y}
    return out | {f"={int(gap)}{k}": float(steps[gap][k] - steps_late[gap][k] / at) for gap in steps for k in range(4)}


def piece_lengths(plain: list[str]) -> Counter[int]:
    return Counter(len(piece) for p in plain for piece in rx(r"[。！？]+[”」』]*").split(p))


def model_of(weights: dict[str, float], evidence: dict[str, float], lengths: dict[int, int]) -> Model:
    """The model of mean weights; a stretch is long that is longer than all but one in a thousand sentences."""
    above, longest = sum(lengths.values()) // 1000, 1 << 30
    for size in sorted(lengths, reverse=True):
        longest, above = size, above - lengths[size]
        if above < 0:
            break
    steps = {gap: [weights.get(f"={int(gap)}{k}", 0.0) for k in range(4)] for gap in (True, False)}
    return Model({f: x for f, x in weights.items() if x and f[0] != "="}, steps, evidence, longest)


def labelled_counts() -> Counter[str]:
    own = [examples(line.replace("|", "\n\n")) for line in LABELLED]
    return counts_of([seq for x, _, _ in own for seq in x], [p for _, x, _ in own for p in x])


def train(texts: list[tuple[list[list[Place]], list[Place], list[str]]]) -> Model:
    """The model of the examples of texts and of the labelled lines, all in one shard."""
    evidence = evidence_of(counts_of([seq for x, _, _ in texts for seq in x], [p for _, x, _ in texts for p in x]) + labelled_counts())
    return model_of(fitted(texts, evidence), evidence, piece_lengths([p for _, _, x in texts for p in x]))


def learn(docs: DataFrame) -> Model:
    """The model, of all documents: words are counted over all of them, and each shard of them fits weights in a task, of
    which the mean is taken. Shards are told by a hash of the id, so that the model does not rest on how tables are split."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    shards = max(1, math.ceil((rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0) / SHARD_CHARS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard")

    def describe(part: pd.DataFrame) -> pd.DataFrame:
        texts = [examples(t) for t in part.sort_values(["doc_id", "text"])["text"]]
        counts = counts_of([seq for x, _, _ in texts for seq in x], [p for _, x, _ in texts for p in x])
        counts.update({f"l={size}": n for size, n in piece_lengths([p for _, _, x in texts for p in x]).items()})
        return pd.DataFrame({"found": [zlib.compress(pickle.dumps(texts), 1)], "keys": [list(counts)], "ns": [list(counts.values())]})

    kept = cut_lineage(rows.groupBy("shard").applyInPandas(describe, "found binary, keys array<string>, ns array<bigint>"))
    summed = kept.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ns").alias("n")))).groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = Counter(dict(zip(summed["key"], summed["n"].tolist())))
    lengths = {int(k[2:]): n for k, n in counts.items() if k.startswith("l=")}
    evidence = evidence_of(Counter({k: n for k, n in counts.items() if not k.startswith("l=")}) + labelled_counts())
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for found in part["found"]:
                weights = fitted(pickle.loads(zlib.decompress(found)), shared.value)
                yield pd.DataFrame({"feature": list(weights), "w": list(weights.values())})

    # rounded, as sums of another order differ in their last digits
    mean = F.round(F.sum("w") / max(kept.count(), 1), 9).alias("w")
    weights = kept.select("found").mapInPandas(fit, "feature string, w double").groupBy("feature").agg(mean).toPandas()
    shared.unpersist()
    return model_of(dict(zip(weights["feature"], weights["w"])) or fitted([], evidence), evidence, lengths)


def decode(text: str, a: int, b: int, model: Model) -> list[int]:
    """Ends of the sentences of a stretch: the best tagging by Viterbi."""
    spots = described(text, a, b)
    if not spots and b - a > model.longest and not rx(r"\s").search(text, a, b):
        spots = gaps(text, a, b)  # longer than sentences are, and without a mark
    if not spots:
        return [b]
    tags = viterbi([model.score(x) if x.follow != "end" else 0.0 for _, x in spots], model.steps[spots[0][1].kind == "gap"], [1 if x.follow == "end" else None for _, x in spots])
    ends = [end for (end, _), tag in zip(spots, tags) if tag]
    return ends if ends and not text[ends[-1] : b].strip() else [*ends, b]


def sentences_of(raw: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in code points of the text as it is."""
    if not raw:
        return []
    text, index = cleaned(raw)
    out = []
    for a, b, _paragraph in runs(text):
        at = a
        for end in decode(text, a, b, model):
            piece = text[at:end]
            if piece.strip():
                s, e = at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())
                out.append((s, e) if index is None else (int(index[s]), int(index[e - 1]) + 1))
            at = end
    return out


def sentences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, char_start, char_end) of every sentence of every document.

    Null, empty and blank texts have no rows; documents repeated under one id repeat their rows; the model may be
    given, or is learned from docs. An empty table gives an empty table. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, starts, ends = [], [], []
            for doc_id, raw in zip(part["doc_id"], part["text"]):
                spans = sentences_of(raw, shared.value)
                ids += [doc_id] * len(spans)
                starts += [s for s, _ in spans]
                ends += [e for _, e in spans]
            yield pd.DataFrame({"doc_id": ids, "char_start": starts, "char_end": ends})

    rows = spread(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
    return rows.mapInPandas(run, "doc_id long, char_start int, char_end int")

"""Sentence boundaries across languages and scripts, by a linear-chain model with Viterbi decoding.

Structure comes first: blank lines, headings, fenced blocks and list items bound blocks. Within a block every character is
tagged boundary or inside; only a mark with its closing quotes, or a blank between two letters of a script that writes no
marks (Thai, Lao), can be a boundary, and its tag depends on what it emits and on the tag of the mark before it.

The model is counted over all documents, without labels. The last mark of a block ends a sentence for certain, so a kind of
mark (the word before it, or how its quotation was opened) that ends sentences is found at block ends about as often as
marks in general, and one that never is there doesn't: abbreviations, initials, ordinals and quotations that go on. Kinds
that are certain then teach what follows a boundary, and how tags follow each other. Scripts without marks are trained on text
stripped of its blanks: which letters stand before and after a boundary. A blank there is an end unless the letters speak
clearly against it (``BLANK``, less than what letters can say).

Texts are read twice in Python: once to find their candidates, which are kept as a compact table that counting, teaching and
decoding work on, and once, those with Thai or Lao only, to count letters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.session import cut, spread

KNOWN_KINDS = 1_000_000  #: kinds of marks with a score of their own that tasks hold as one list; a longer one is joined
EVIDENCE = 2.0  #: log odds from sightings inside blocks from which a kind gets a score of its own
CLAIM = 50.0  #: log odds from which a kind that ends sentences gets one
CERTAIN = 4.0  #: log odds from which a kind teaches
CLIP = 8.0
BLANK = 6.0  #: log odds of a blank between two Thai or Lao letters before the letters are looked at; they may say up to CLIP
LONG_WORD = 3.0  #: log odds of a word over three letters, before its counts, not to be an abbreviation
NEVER = 0.004  #: how often a kind that ends no sentence is the last of a block all the same
DOUBT = 1.0  #: boundaries that runs of letters count as seen, and as expected, before any is

#: Fixed values.
WIDE_MARKS = "。！？｡．।॥؟۔។៕။།༎።፧։"
OPENERS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "‘": "’", "‚": "‘"}
CLOSERS = "\"'”’“»›」』)）]】》〉"
BLANK_SCRIPTS = ("ก-ฺเ-๎", "ກ-ຽເ-ໍໜ-ໟ")

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:[-*]|\d{1,9}[.)])[ \t\xa0]+(?=\S)")
_BLANK = "|".join(rf"(?<=[{x}])[ \t\xa0]+(?=[{x}])" for x in BLANK_SCRIPTS)
_CANDIDATE = re.compile(rf"(?P<mark>[.!?…{WIDE_MARKS}]+)|(?P<bare>{_BLANK})")
_LETTER = re.compile(f"[{''.join(BLANK_SCRIPTS)}]")
_RUN = re.compile(f"[{''.join(BLANK_SCRIPTS)}]+")
_QUOTE = re.compile("[" + re.escape("".join(OPENERS) + "".join(OPENERS.values()) + '"') + "]")
_IDENT = re.compile(r"[A-Za-z_$][\w$./-]*(?:[a-z0-9][A-Z]|[._/][A-Za-z]|\(\))[\w$./()-]*\Z")
_LETTERS = re.compile(r"(?:\w{1,2}\.)+\w{1,2}")
_AFTER = re.compile(r"[\s﻿]*(\S{0,80})")  # a name is looked at up to 80 characters
_SPACE = re.compile(r"[\s\ufeff]*")
_CLOSING = re.compile("[ \xa0 " + re.escape(CLOSERS) + "]*")

#: What a candidate's code holds: what follows it, how far it is from the one before, and what an unknown kind is taken for.
FOLLOWS = ("end", "upper", "lower", "ident", "digit", "open", "letter")
GAPS = ("near", "mid", "far")
GROUPS = ("g:none", "g:number", "g:long", "g:inner", "g:short", "m:", "q:start", "q:none", "q::", "q:：", "q:,", "q:，", "q:、", "bare")
LAST = -1  #: the code of the last character of a block
_BARE = GROUPS.index("bare")


def _code(follow: str, gap: str, group: str) -> int:
    return FOLLOWS.index(follow) | GAPS.index(gap) << 3 | GROUPS.index(group) << 5


_CODES = {(f, g, x): _code(f, g, x) for f in FOLLOWS for g in GAPS for x in GROUPS}


def blank(text: str) -> bool:
    return not text.strip(" \t\r\n\f\v﻿") or not text.replace("﻿", "").strip()


def blocks(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of headings, fences, list items (without their marker) and paragraphs, in order."""
    out: list[tuple[str, int, int]] = []
    fence, before = "", "blank"
    for m in _LINE.finditer(text):
        s, e = m.span()
        if s == e:
            continue
        line = m[0]
        lead = 1 if s == 0 and line.startswith("﻿") else 0
        body = line[lead:]
        if fence:
            out[-1] = ("fence", out[-1][1], e)
            if body.strip().startswith(fence) and not body.strip().strip(fence[0]):
                fence, before = "", "fence"
        elif blank(body):
            before = "blank"
        elif f := _FENCE.match(body):
            fence = f[1]
            out.append(("fence", s + lead, e))
        elif _HEADING.match(body):
            out.append(("heading", s + lead, e))
            before = "heading"
        elif before != "text" and (i := _ITEM.match(body)):
            out.append(("item", s + lead + i.end(), e))
            before = "item"
        elif before == "text":
            out[-1] = ("text", out[-1][1], e)
        else:
            out.append(("text", s + lead, e))
            before = "text"
    return out


def _pairs(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Outermost (open, close) positions of matched quotes and brackets. Unmatched ones count as nothing."""
    stack: list[tuple[str, int]] = []
    waits: dict[str, int] = {}
    found = []
    for m in _QUOTE.finditer(text, s, e):
        c, at = m[0], m.start()
        if waits.get(c):
            while True:
                want, begin = stack.pop()
                waits[want] -= 1
                if want == c:
                    break
            found.append((begin, at))
        elif c == '"' or c in OPENERS and not (c in "‘‚" and at > s and text[at - 1].isalnum()):
            stack.append((OPENERS.get(c, c), at))
            waits[OPENERS.get(c, c)] = waits.get(OPENERS.get(c, c), 0) + 1
    if not found:
        return found
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _last_word(text: str) -> str:
    """What stands after the last white space."""
    return text.rsplit(None, 1)[-1] if text and not text[-1].isspace() else ""


def _word_kind(text: str, s: int, at: int) -> tuple[str, str]:
    whole = _last_word(text[max(s, at - 60) : at])
    word = whole.lstrip("\"'“„«‹「『(（[¿¡")
    if not word:
        return "w:", "g:none"
    if word.isdigit():
        before = _last_word(text[max(s, at - len(whole) - 40) : at - len(whole)].rstrip())
        return f"n:{before.lower()[-20:]}", "g:number"
    if not word.isalpha():
        if any(c.isdigit() for c in word):
            return ("v:dotted", "g:long") if "." in word else ("v:mixed", "g:long")
        if _IDENT.match(word) and not _LETTERS.fullmatch(word):
            return "v:ident", "g:long"
    elif _IDENT.match(word):
        return "v:ident", "g:long"
    group = "g:inner" if "." in word else "g:short" if len(word) <= 3 else "g:long"
    return f"w:{word[-24:]}", group


def _follow(text: str, at: int, e: int) -> str:
    m = _AFTER.match(text, at, e)
    word = m[1] if m else ""
    if not word:
        return "end"
    c = word[0]
    if c.isdigit():
        return "digit"
    if not c.isalpha():
        return "open"
    if not c.islower():
        return "upper" if c.isupper() else "letter"
    return "ident" if _IDENT.match(word.rstrip(".,;:!?)»”\"'")) else "lower"


def _char_before(text: str, s: int, at: int) -> str:
    """The last character before ``at`` that is no white space; empty at the start."""
    while at > s and text[at - 1].isspace():
        at -= 1
    return text[at - 1] if at > s else ""


def candidates(text: str, s: int, e: int, last: int) -> Iterator[tuple[int, int, str]]:
    """(end, code, kind) of the places of a block where a sentence may end. ``last`` is where its last character ends."""
    outer = _pairs(text, s, e)
    opens = [a for a, _ in outer]
    before, skip = s, s
    for m in _CANDIDATE.finditer(text, s, e):
        a, b = m.span()
        if a < skip:
            continue
        k = bisect_right(opens, a) - 1 if opens else -1
        inside = k >= 0 and outer[k][1] > a
        mark = m["mark"]
        if mark is None:
            if not inside:
                yield a, _CODES["letter", "far", "bare"], f"b:{_letters(text[max(s, a - 3) : a], -1)}|{_letters(text[b : b + 3], 1)}"
            continue
        if mark != "." and (mark == "。。。" or not mark.strip(".…")):
            continue  # an ellipsis alone
        end = b
        if inside:
            close = outer[k][1]
            if _CLOSING.match(text, b, close).end() < close:
                continue
            end = close + 1
        while end < last and text[end] in CLOSERS and not (text[end] in OPENERS or text[end] == '"' and bisect_right(opens, end) > k + 1 + (not inside)):
            end += 1
        skip = end
        if end < last:
            c = text[end]
            wide = mark[-1] in WIDE_MARKS or text[end - 1] in "」』”）】》〉"
            if not (c.isspace() or c == "\ufeff" or wide and (c.isalnum() or c in OPENERS or c == '"')):
                continue
            if c.isspace() and (after := _SPACE.match(text, end, last).end()) < last and text[after] in "，、,;:；：":
                continue
        if inside:
            p = _char_before(text, s, outer[k][0])
            bracket = text[outer[k][0]] in "(（[【"
            intro = "start" if not p or p in ".!?…" + WIDE_MARKS + CLOSERS else p if p in ":：,，、" else "none"
            kind, group = f"q:{intro}{'' if bracket else mark[-1]}{text[outer[k][1]]}", f"q:{intro}"
        elif mark == ".":
            kind, group = _word_kind(text, s, a)
        else:
            kind, group = f"m:{mark[-1]}", "m:"
        gap = "near" if end - before <= 5 else "mid" if end - before <= 14 else "far"
        before = end
        yield min(end, last), _CODES["end" if end >= last else _follow(text, end, e), gap, group], kind


def _letters(text: str, side: int) -> str:
    """The run of Thai or Lao letters at an end of a text: its last ones for side -1."""
    runs = _RUN.findall(text)
    return runs[-1 if side < 0 else 0]


def places(text: str) -> Iterator[tuple[int, int, str]]:
    """(end, code, kind) of all candidates and of the last character of each block, in order."""
    for kind, s, e in blocks(text):
        last = e
        while last > s and (text[last - 1].isspace() or text[last - 1] == "\ufeff"):
            last -= 1
        if kind in ("text", "item"):
            yield from candidates(text, s, e, last)
        if last > s:
            yield last, LAST, ""


@dataclass
class Model:
    """Log odds of boundary against inside. ``kinds`` is None where they are joined to the candidates."""

    kinds: dict[str, float] | None = field(default_factory=dict)
    groups: dict[str, float] = field(default_factory=dict)
    follows: dict[str, float] = field(default_factory=dict)
    steps: dict[tuple[str, int, int], float] = field(default_factory=dict)  # log P(tag | tag before, gap)
    letters: dict[str, float] = field(default_factory=dict)
    table: DataFrame | None = None  # kind, odds

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def known(self, code: int, kind: str, odds: float | None) -> float:
        """The score of a candidate's kind; ``odds`` is its own one, where kinds are joined."""
        if self.kinds is not None:
            odds = self.kinds.get(kind)
        return self.groups.get(GROUPS[code >> 5], 0.0) if odds is None else odds

    def emission(self, code: int, kind: str, odds: float | None) -> float:
        if code >> 5 == _BARE:
            left, right = kind[2:].split("|")
            said = sum(self.letters.get(f"<{left[-n:]}", 0.0) for n in range(1, len(left) + 1)) + sum(self.letters.get(f">{right[:n]}", 0.0) for n in range(1, len(right) + 1))
            return BLANK + max(-CLIP, min(CLIP, said))
        return self.known(code, kind, odds) + self.follows.get(FOLLOWS[code & 7], 0.0)

    def viterbi(self, codes: list[int], emissions: list[float]) -> list[int]:
        """The best tags (1: boundary). The start of a block counts as following a boundary."""
        even = math.log(0.5)
        inside, ends, back = -math.inf, 0.0, []
        for code, e in zip(codes, emissions):
            (s00, s01), (s10, s11) = self._steps.get(code >> 3 & 3, ((even, even), (even, even)))
            to0, to1 = ends + s10 > inside + s00, ends + s11 > inside + s01
            inside, ends = (ends + s10 if to0 else inside + s00), (ends + s11 if to1 else inside + s01) + e
            back.append((to0, to1))
        tag, tags = ends > inside, []
        for came in reversed(back):
            tags.append(int(tag))
            tag = came[tag]
        return tags[::-1]

    @property
    def _steps(self) -> dict[int, tuple]:
        if (held := self.__dict__.get("_held")) is None:
            held = self.__dict__["_held"] = {i: tuple(tuple(self.steps[g, p, t] for t in (0, 1)) for p in (0, 1)) for i, g in enumerate(GAPS) if (g, 0, 0) in self.steps}
        return held

    def ends(self, at: list[int], codes: list[int], emissions: list[float]) -> list[int]:
        """The indexes of those places that end a sentence."""
        out, mine = [], []
        for i, code in enumerate(codes):
            if code != LAST:
                if code & 7:  # not the last of its block
                    mine.append(i)
                continue
            mine = [j for j in mine if at[j] < at[i]]
            if mine:
                tags = self.viterbi([codes[j] for j in mine], [emissions[j] for j in mine])
                out += [j for j, tag in zip(mine, tags) if tag]
                mine = []
            out.append(i)
        return out


def sentence_ends(text: str, model: Model) -> list[int]:
    found = list(places(text))
    if not found:
        return []
    at, codes, kinds = map(list, zip(*found))
    return [at[i] for i in model.ends(at, codes, [0.0 if c == LAST else model.emission(c, k, None) for c, k in zip(codes, kinds)])]


def _flat_places(b: pa.RecordBatch, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's places begin, and the codes and scores of all places of a batch. Equal places are scored once."""
    lists = b.column("code")
    begins = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    codes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = b.column("kind").flatten().dictionary_encode()
    names = kinds.dictionary.to_pylist()
    pairs, first, place = np.unique(codes * len(names) + kinds.indices.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    own = b.column("odds")
    odds = own.flatten().to_numpy(zero_copy_only=False)[first].tolist() if own.null_count == 0 else [math.nan] * len(first)
    scores = [0.0 if codes[i] == LAST else score(int(codes[i]), names[p % len(names)], None if math.isnan(o) else o) for i, p, o in zip(first.tolist(), pairs.tolist(), odds)]
    return begins, codes, np.array(scores, np.float64)[place]


def _count_letters(text: str, seen: Counter) -> None:
    """Counts runs of Thai and Lao letters before and after each place of blank-stripped text: at boundaries ("e") or not."""
    for kind, s, e in blocks(text):
        if kind not in ("text", "item") or not _LETTER.search(text, s, e):
            continue
        bare, at, size, begin = [], set(), 0, s
        for end, code, _ in candidates(text, s, e, e):
            if code >> 5 == _BARE:
                bare.append(text[begin:end])
                size += end - begin
                begin = _SPACE.match(text, end, e).end()
                at.add(size)
        stripped = "".join(bare) + text[begin:e]
        for run in _RUN.finditer(stripped):
            a, z = run.span()
            for i in range(a + 1, z):
                b = "e" if i in at else "n"
                for n in range(1, min(3, i - a) + 1):
                    seen["<" + stripped[i - n : i], b] += 1
                for n in range(1, min(3, z - i) + 1):
                    seen[">" + stripped[i : i + n], b] += 1


def _counted(df: DataFrame, work) -> DataFrame:
    """``key, what, n`` summed over all rows; every batch is counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for row in zip(*(c.to_pylist() for c in b.columns)):
                work(*row, seen)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen]), pa.array([w for _, w in seen]), pa.array(list(seen.values()), pa.int64())], names=["key", "what", "n"])

    return df.mapInArrow(run, "key string, what string, n long").groupBy("key", "what").agg(F.sum("n").alias("n"))


def find_places(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, at, next, code, kind``: the candidates and block ends of each text with any, the first step of all others.

    ``next`` has one entry more: where the text's first character stands that is no white space, and the first one after
    each place.
    """
    src = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()))
    schema = T.StructType([T.StructField("key", src.schema["key"].dataType), *(T.StructField(c, T.ArrayType(k)) for c, k in (("at", T.IntegerType()), ("next", T.IntegerType()), ("code", T.IntegerType()), ("kind", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, nxt, codes, kinds, ends = [], [], [], [], [], [0]
            for i, t in enumerate(b.column("text").to_pylist()):
                found = list(places(t))
                if found:
                    a, c, k = zip(*found)
                    rows.append(i), at.extend(a), codes.extend(c), kinds.extend(k), ends.append(len(at))
                    nxt.append(_SPACE.match(t).end()), nxt.extend([_SPACE.match(t, x).end() for x in a])
            if rows:
                held = lambda values, kind, more=0: pa.ListArray.from_arrays(pa.array(np.array(ends) + more * np.arange(len(ends)), pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows)), held(at, pa.int32()), held(nxt, pa.int32(), 1), held(codes, pa.int32()), held(kinds, pa.string())], names=["key", "at", "next", "code", "kind"])

    return src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _with_odds(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``odds``: each candidate's own score, joined where tasks don't hold the list of kinds."""
    if model.kinds is not None:
        return found.withColumn("odds", F.lit(None).cast("array<double>"))
    each = found.select("row", F.posexplode("kind").alias("i", "kind")).join(model.table, "kind")
    own = each.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "odds"))).alias("own"))
    odds = F.transform(F.sequence(F.lit(0), F.size("kind") - 1), lambda i: F.coalesce(F.col("own")[i], F.lit(float("nan"))))
    return found.join(own, "row", "left").withColumn("odds", odds).drop("own")


def train(documents: DataFrame, text: str = "text", *, found: DataFrame | None = None) -> Model:
    """Counts the model over all documents; ``found`` are their places, if they are at hand.

    Every kind with evidence gets its score. Up to ``KNOWN_KINDS`` of them are held in a list, more stay a table that is
    joined. Groups, transitions and runs of up to three letters of two alphabets are few.
    """
    if found is None:
        found = cut(find_places(documents.withColumn("_row", F.monotonically_increasing_id()), "_row", text))
    each = found.select(F.inline(F.arrays_zip("code", "kind"))).where((F.col("code") != LAST) & (F.shiftright("code", 5) != _BARE))
    table = cut(each.groupBy("kind", F.shiftright("code", 5).alias("grp")).agg(F.count("*").alias("n"), F.count(F.when(F.col("code").bitwiseAND(7) == 0, 1)).alias("e")))
    groups = {GROUPS[r.grp]: r for r in table.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).collect()}
    strong = groups.get("m:")
    rate = min(0.9, max(0.02, ((strong.e if strong else 0) + 1) / ((strong.n if strong else 0) + 5)))
    at_end, inner = math.log(rate / NEVER), math.log((1 - rate) / (1 - NEVER))
    model = Model()
    for name, r in groups.items():
        model.groups[name] = max(-1.0, min(3.0, r.e * at_end + (r.n - r.e) * inner))
    kinds = table.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    kinds = kinds.withColumn("odds", F.col("e") * at_end + (F.col("n") - F.col("e")) * inner)
    against = (F.col("n") - F.col("e")) * -inner
    kinds = kinds.where(F.col("kind").startswith("q:") | (F.col("odds") < CERTAIN) & (against >= EVIDENCE) | (F.col("odds") >= CLAIM))
    longer = F.when(F.col("kind").startswith("w:") & (F.length("kind") > 5) & ~F.contains("kind", F.lit(".")), LONG_WORD).otherwise(0.0)
    model.table = cut(kinds.select("kind", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("odds") + longer)).alias("odds")))
    model.kinds = {r.kind: r.odds for r in model.table.collect()} if model.table.count() <= KNOWN_KINDS else None

    bare = spread(documents.select(text).where(F.col(text).rlike(f"[{''.join(BLANK_SCRIPTS)}]")))
    letters: dict[str, list[int]] = {}
    for r in _counted(bare, _count_letters).collect():  # runs of up to three letters of two alphabets
        letters.setdefault(r.key, [0, 0])[r.what == "e"] = r.n
    n, e = (sum(v[i] for k, v in letters.items() if k[0] == "<" and len(k) == 2) for i in (0, 1))
    share = (e + 1) / (n + e + 2)
    for k, (off, on) in letters.items():
        model.letters[k] = max(-2.0, min(2.0, math.log((on + DOUBT) / ((on + off) * share + DOUBT))))  # seen against expected

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts what follows certain tags, and how tags follow each other: ``f`` (follow, tag) and ``s`` (gap, tag before, tag)."""
        for b in batches:
            _, codes, known = _flat_places(b, model.known)
            last = codes == LAST
            bare = ~last & (codes >> 5 == _BARE)
            follow, gap = codes & 7, codes >> 3 & 3
            tag = np.where(last | bare | (follow == 0), 1, np.where(np.abs(known) >= CERTAIN, known > 0, -1)).astype(np.int64)
            before = np.concatenate([[1], tag[:-1]])  # a row ends with the end of a block
            sure = ~last & ~bare & (tag >= 0)
            f = np.bincount((follow * 2 + tag)[sure & (follow > 0)], minlength=2 * len(FOLLOWS))
            t = np.bincount((gap * 4 + before * 2 + tag)[sure & (before >= 0)], minlength=4 * len(GAPS))
            yield pa.RecordBatch.from_arrays([pa.array(["f"] * len(f) + ["s"] * len(t)), pa.array([*range(len(f)), *range(len(t))], pa.int32()), pa.array(np.concatenate([f, t]), pa.int64())], names=["key", "at", "n"])

    taught = _with_odds(found, model).select("code", "kind", "odds").mapInArrow(certain, "key string, at int, n long").groupBy("key", "at").agg(F.sum("n").alias("n"))
    seen = {(r.key, r.at): r.n for r in taught.collect()}  # a row for each cell of two small tables
    total = [sum(seen.get(("f", 2 * i + t), 0) for i in range(1, len(FOLLOWS))) + 6 for t in (0, 1)]
    for i, f in enumerate(FOLLOWS[1:], 1):
        no, yes = (seen.get(("f", 2 * i + t), 0) + 1 for t in (0, 1))
        model.follows[f] = max(-3.0, min(3.0, math.log(yes / total[1]) - math.log(no / total[0])))
    for i, gap in enumerate(GAPS):
        for p in (0, 1):
            n = [seen.get(("s", 4 * i + 2 * p + t), 0) + 5 for t in (0, 1)]
            for t in (0, 1):
                model.steps[gap, p, t] = math.log(n[t] / sum(n))
    return model


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", *, model: Model | None = None) -> DataFrame:
    """``key, sent_no, sent_start, sent_end``: each sentence of each text in order, in code points.

    ``sent_start`` is its first and ``sent_end`` the place after its last character that is not white space. Null, empty and
    blank texts have no sentence. Rows repeated exactly count once. Texts are read whole, whatever their length; the work
    is linear in it.
    """
    found = cut(find_places(documents, key, text))
    model = model or train(documents, text, found=found)
    schema = T.StructType([T.StructField(key, found.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("sent_no", "sent_start", "sent_end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, no, start, end = [], [], [], []
            begins, codes, emissions = _flat_places(b, model.emission)
            at, nxt, begins = b.column("at").flatten().to_pylist(), b.column("next").flatten().to_pylist(), begins.tolist()
            codes, emissions = codes.tolist(), emissions.tolist()
            for i, (s, e) in enumerate(zip(begins, begins[1:])):
                own = at[s:e]
                shift = s + i  # of the row's first entry in next
                begin = nxt[shift]
                for k, j in enumerate(model.ends(own, codes[s:e], emissions[s:e])):
                    rows.append(i), no.append(k), start.append(begin), end.append(own[j])
                    begin = nxt[shift + j + 1]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows)), *(pa.array(v, pa.int64()) for v in (no, start, end))], names=[key, "sent_no", "sent_start", "sent_end"])

    return _with_odds(found, model).select("key", "at", "next", "code", "kind", "odds").mapInArrow(run, schema).distinct()

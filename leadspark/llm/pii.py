"""Personal data in texts, with patterns that bootstrap themselves from seed entities.

Seeds are what plain rules find: e-mail and IP addresses, card numbers that pass the Luhn test and telephone numbers (``base_spans``).
Other strings that look like identifiers are *candidates*: parts of number runs that a rule dropped as a whole (a telephone number
next to a card number), numbers without a plus sign, addresses with "(at)" or without a dotted domain, groups of hexadecimal
digits between colons. Every seed and candidate occurs in lexical *patterns*: the word before it, the two words before it, the
words on both sides, and its own shape (digits as 0, letters as a).

Patterns and instances form a graph of distinct pairs, which Spark scores in rounds:

* A pattern's confidence for a kind is the weight of its known instances of that kind over that of all its known ones (other kinds, and
  words with digits that are no identifiers), half an instance added to the latter. It is accepted from ``SUPPORT`` instances and
  ``CONFIDENT`` on.
* A candidate's score for a kind it can be is 1 - product(1 - confidence) over its accepted patterns; from ``PROMOTED`` on it is a known
  instance of its best kind, with that weight, and teaches patterns in the next round. Rounds end when one promotes nothing.

All occurrences of promoted instances are added, leftmost first and longest at equal starts, where they overlap no span of their
kind. Positions are in code points, ends exclusive. Every scan is linear in the text. Null and empty texts have no spans. Repeated rows
are distinct rows with the same spans, and count once as instances. Ties between kinds go to the first in ``KINDS``. An empty table gives
an empty result. Columns other than ``doc_id`` and the text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import slices, whole_text
from leadspark.operators.staging import materialize

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
SUPPORT = 5
CONFIDENT = 0.9
PROMOTED = 0.9

_GAP = re.compile(r"[\x20\x09-\x0D]+")
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"@|[(\[{]at[)\]}]")
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[int, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(text: str) -> bool:
    found = digits(text)
    return 12 <= len(found) <= 19 and luhn(found)


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(kind, start, end) that the rules keep, by start and then kind, and the card and phone matches that they drop."""
    kept: list[Span] = []
    dropped: list[Span] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            # A local part is the whole run of its characters before the sign, back to the last match.
            at = m.start()
            while at > end and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                kept.append((0, at, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            kept.append((1, *m.span()))
    for m in _CARD.finditer(text):
        (kept if _card(m[0]) else dropped).append((2, *m.span()))
    for m in _PHONE.finditer(text):
        (kept if 9 <= len(digits(m[0])) <= 15 else dropped).append((3, *m.span()))
    return sorted(kept, key=lambda s: (s[1], s[0])), dropped


def _bit(*kinds: int) -> int:
    return sum(1 << k for k in kinds)


def candidates(text: str, kept: list[Span], dropped: list[Span]) -> list[tuple[int, int, int]]:
    """(kinds as bits, start, end) of strings that may be identifiers, outside kept spans; 0 bits: words that are none."""
    found: dict[tuple[int, int], int] = {}
    for kind, start, end in dropped:
        words = [(start + m.start(), start + m.end()) for m in _WORD.finditer(text[start:end])]
        if len(words) < 2:
            continue
        if kind == 3:
            for _, stop in words[:-1]:
                if 9 <= len(digits(text[start:stop])) <= 15:
                    found[start, stop] = _bit(3)
                if stop - start > 64:
                    break
        else:
            for i, (first, _) in enumerate(words):
                for _, stop in words[i:i + 5]:
                    if _card(text[first:stop]):
                        found[first, stop] = _bit(2)
    for m in _AT.finditer(text):
        start, end = m.span()
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while end < len(text) and text[end] in _LOCAL:
            end += 1
        while end > m.end() and text[end - 1] in ".%+-":
            end -= 1
        if start < m.start() and end > m.end() and not (m[0] == "@" and _DOMAIN.match(text, m.start())):
            found[start, end] = _bit(0)
    for m in _COLONS.finditer(text):
        if sum(c not in ":" for c in m[0]) >= 3:
            found[m.span()] = _bit(1)
    for m in _NUMBER.finditer(text):
        n = len(digits(m[0]))
        if 7 <= n <= 15 and "+" != text[m.start() - 1:m.start()]:
            found[m.span()] = found.get(m.span(), 0) | _bit(3)
    # Words with a digit that belong to nothing: evidence against a pattern.
    taken = sorted([*((s, e) for _, s, e in kept), *found])
    reach, at, merged = -1, 0, []
    for s, e in taken:
        reach = max(reach, e)
        merged.append((s, reach))
    for m in _ANY.finditer(text):
        if m.start() < at:
            continue
        start, at = m.start(), m.end()
        while start and not _GAP.match(text, start - 1):
            start -= 1
        gap = _GAP.search(text, at)
        at = gap.start() if gap else len(text)
        if not _meets(merged, start, at):
            found[start, at] = 0
    # By kind: what overlaps a kept span of its own kind is no candidate.
    by_kind = [sorted((s, e) for k, s, e in kept if k == kind) for kind in range(OTHER)]
    out = []
    for (s, e), bits in sorted(found.items()):
        left = sum(1 << k for k in range(OTHER) if bits >> k & 1 and not _meets(by_kind[k], s, e))
        if left or not bits:
            out.append((left, s, e))
    return out


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span in order of start, with ends that never fall, overlaps [start, end)."""
    lo, hi = 0, len(spans)
    while lo < hi:
        mid = (lo + hi) // 2
        if spans[mid][1] <= start:
            lo = mid + 1
        else:
            hi = mid
    return lo < len(spans) and spans[lo][0] < end


def shape(text: str) -> str:
    """Letters as one a per run, digits as 0, other signs as they are."""
    return re.sub("[0-9]", "0", re.sub(r"[^\W\d_]+", "a", text[:64]))


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns that a span stands in; words in lower case with digits as 0."""
    def words(part: str) -> list[str]:
        return [re.sub("[0-9]", "0", w.lower())[-24:] for w in _GAP.split(part) if w]

    before, after = words(text[max(0, start - 64):start])[-2:], words(text[end:end + 64])[:1]
    out = ["S " + shape(text[start:end])]
    if before:
        out.append(f"L {before[-1]}")
        if after:
            out.append(f"B {before[-1]} _ {after[0]}")
    if len(before) == 2:
        out.append(f"P {before[0]} {before[1]}")
    return out


def instance(kind: str, text: str) -> str:
    """What equal identifiers have in common."""
    return f"{kind} {digits(text) if kind in ('card', 'phone', 'number') else text.lower()[:128]}"


_SPAN = "struct<kind:int,start:int,stop:int>"
_SEEN = "struct<kind:int,kinds:int,start:int,stop:int,instance:string,patterns:array<string>>"
_SCAN = f"row bigint, doc_id bigint, base array<{_SPAN}>, seen array<{_SEEN}>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per text: its base spans, and with their patterns all known and possible identifiers. ``kind`` is null in candidates."""
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    seen_type = pa.list_(pa.struct([("kind", pa.int32()), ("kinds", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
                                    ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            base, seen = [], []
            for value in batch.column(1).to_pylist():
                kept, here = [], []
                if _ANY.search(value):
                    kept, dropped = base_spans(value)
                    here = [(k, 0, s, e, instance(KINDS[k], value[s:e]), patterns(value, s, e)) for k, s, e in kept]
                    for bits, s, e in candidates(value, kept, dropped):
                        kind = "number" if bits & _bit(2, 3) else "other" if not bits else "text"
                        here.append((None if bits else OTHER, bits, s, e, instance(kind, value[s:e]), patterns(value, s, e)))
                base.append([dict(zip(("kind", "start", "stop"), x, strict=True)) for x in kept])
                seen.append([dict(zip(("kind", "kinds", "start", "stop", "instance", "patterns"), x, strict=True)) for x in here])
            n = len(base)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(base, spans), pa.array(seen, seen_type)],
                                             names=["row", "doc_id", "base", "seen"])
            row += n

    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, _SCAN))


def bootstrap(seen: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, promoted: float = PROMOTED) -> DataFrame:
    """(instance, kind, weight) of candidates that high-confidence patterns found, from rows of (kind, kinds, instance, patterns)."""
    edges = materialize(seen.select("kind", "kinds", "instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance", "kind").agg(
        F.bit_or("kinds").alias("kinds")))
    seeds = edges.where("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("weight"))
    open_ = edges.where("kind is null").select("pattern", "instance", F.explode(F.sequence(F.lit(0), F.lit(OTHER - 1))).alias("kind"), "kinds").where(
        F.expr("shiftright(kinds, kind) & 1 = 1")).drop("kinds")
    # Seeds never change: what they tell of a pattern is summed once.
    taught = materialize(seeds.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    # Only patterns that some seed of a kind stands in can be accepted before candidates teach others.
    found = None
    while True:
        told = taught
        if found is not None:
            own = edges.where("kind is null").select("pattern", "instance").join(found, "instance")
            told = told.unionByName(own.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
        sums = told.groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
        total = Window.partitionBy("pattern")  # a row per kind
        scored = sums.withColumn("confidence", F.col("weight") / (F.sum("weight").over(total) + 0.5))
        accepted = scored.where((F.col("kind") < OTHER) & (F.col("n") >= support) & (F.col("confidence") >= confident)).select("pattern", "kind", "confidence")
        scores = open_.join(accepted, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("weight")).where(F.col("weight") >= promoted)
        # Equal weights go to the first kind.
        best = scores.groupBy("instance").agg(F.max(F.struct(F.round("weight", 12).alias("weight"), (-F.col("kind")).alias("k"))).alias("b")).select(
            "instance", (-F.col("b")["k"]).alias("kind"), F.col("b")["weight"].alias("weight"))
        fresh = materialize(best if found is None else best.join(found, "instance", "left_anti"))
        if fresh.isEmpty():
            return fresh if found is None else found
        found = fresh if found is None else materialize(found.unionByName(fresh))


def personal_data(docs: DataFrame, text: str = "text", support: int = SUPPORT, confident: float = CONFIDENT, promoted: float = PROMOTED) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (kind as its place in KINDS, start, stop) by start and then kind."""
    scanned = scan(docs, text)
    seen = scanned.select("row", F.inline("seen"))
    found = bootstrap(seen.select("kind", "kinds", "instance", "patterns"), support, confident, promoted)
    places = seen.where("kind is null").select("row", "start", "stop", "instance").join(found.select("instance", "kind"), "instance")
    more = places.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("more"))

    def unite(batches):
        for batch in slices(batches):
            out = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(s["start"], s["kind"], s["stop"]) for s in base]
                reach = [0] * OTHER
                for s in sorted(more or (), key=lambda s: (s["start"], -s["stop"])):
                    if s["start"] >= reach[s["kind"]] and not any(
                            k == s["kind"] and a < s["stop"] and s["start"] < b for a, k, b in spans[:len(base)]):
                        spans.append((s["start"], s["kind"], s["stop"]))
                        reach[s["kind"]] = s["stop"]
                out.append([{"kind": k, "start": a, "stop": b} for a, k, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.column(1).type)], names=["doc_id", "base", "spans"])

    return scanned.select("row", "doc_id", "base").join(more, "row", "left").select("doc_id", "base", "more").mapInArrow(
        unite, f"doc_id bigint, base array<{_SPAN}>, spans array<{_SPAN}>")


def as_text(spans: str) -> str:
    """SQL of ``kind:start:end`` of all spans, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.stop)), ',')"

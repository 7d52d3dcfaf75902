"""Token alignment, personal data and hard negatives against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadspark.llm import align, pii, rtree
from leadspark.llm.codec import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = "chunk string, kind string, at string, pair string, n string, links string, row string, base string, seen string, label string"


def same(found, wanted):
    assert Counter(map(repr, found)) == Counter(map(repr, wanted))


# Cross-tokenizer alignment


def naive_alignment(texts):
    """Tokens one by one with the files' own encoders; groups, links and counts by plain loops."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: k for k, c in byte_letters().items()}
    rows = []
    for text in texts:
        data = (" " + text).encode() if text else b""
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        right = []
        for i in b.encode(text or ""):
            piece = b.id_to_piece(i)
            right.append((i, bytes.fromhex(piece[3:5]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
        if not text or b"".join(t for _, t in left) != data or b"".join(t for _, t in right) != data:
            rows.append((0, 0, [], []))
            continue
        ends = []
        for side in (left, right):
            at, here = 0, []
            for i, t in side:
                at += len(t)
                here.append((at, i))
            ends.append(here)
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side if last < e <= cut) for side in ends))
            last = cut
        links = [(i, dict(ends[1])[e]) for e, i in ends[0] if e in dict(ends[1])]
        rows.append((len(left), len(right), groups, links))
    counts = Counter(x for r in rows for x in r[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in rows]


TEXTS = ["The cat sat.", "the  cats\n\nsat é naïve Straße", "<s> </s> <|endoftext|> <unk>", "漢字 and 😀 emoji\t\ttabs", " leading", "trailing ", None, "", " ",
         "a▁b marks a space", "The cat sat.", "x" * 2500 + " end", "1234567 don't we'll 50%", "İΣ ́ x\x1cy\x85z \r\n", "unhappiness internationalization " * 30]


def test_alignment(spark):
    rng = random.Random(5)
    words = [w for t in TEXTS if t for w in t.split(" ")[:40] if len(w) < 30]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = [(k, t, *["c"] * 10) for k, t in enumerate(texts)] + [(None, "no id", *[None] * 10)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASH}").repartition(3)
    found = align.align_texts(docs, A, B).collect()
    same([tuple(r) for r in found], [(r[0], *w) for r, w in zip(rows, naive_alignment([r[1] for r in rows]), strict=True)])
    assert align.align_texts(docs.limit(0), A, B).count() == 0


def test_alignment_in_small_chunks(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string").repartition(2)
    whole = align.align_texts(docs, A, B).collect()
    same(map(tuple, align.align_texts(docs, A, B, chunk=5).collect()), map(tuple, whole))


def test_intervals_coalesce():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        ends = [np.union1d(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), [n]) for _ in range(2)]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        group_a, group_b = align.coalesce(starts[0], ends[0], starts[1], ends[1])
        cuts = np.intersect1d(*ends)
        assert group_a.tolist() == np.searchsorted(cuts, ends[0]).tolist() and group_b.tolist() == np.searchsorted(cuts, ends[1]).tolist()
        pairs = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        assert set(zip(*(x.tolist() for x in align.overlaps(starts[0], ends[0], starts[1], ends[1])), strict=True)) == pairs


# Personal data

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def naive_base(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            number = [int(c) for c in m[0] if c.isdigit()]
            sums = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(number)))
            if (k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 12 <= len(number) <= 19 and sums % 10 == 0
                    or k == 3 and 9 <= len(number) <= 15):
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def test_base_rules():
    rng = random.Random(9)
    parts = ["a@b.c", "@", "a.b+c@x-y.co.uk", "@d.e", "1.2.3.4", "256.1.1.1", "000255.0.0.1", ".5", "+1 (555) 010-2000", "+", "12", " ", "-", "x", "é", "\n", "(", "a@b", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.9 else card(rng) for _ in range(rng.randrange(1, 12)))
        assert pii.base_spans(text)[0] == naive_base(text), text
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 150_000, "12 " * 100_000, "1:" * 150_000):
        pii.candidates(text, *pii.base_spans(text))  # linear, so it ends


def personal_rows():
    rng = random.Random(4)
    fill = [f"word{chr(97 + k)}" for k in range(20)]

    def around(left, middle, right="and"):
        return f"{rng.choice(fill)} {rng.choice(fill)} {left} {middle} {right} {rng.choice(fill)}"

    phone = [f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}" for _ in range(12)]
    mail = [f"user{k}@mail{k % 3}.example.com" for k in range(8)]
    rows = [around("please call", p) for p in phone] + [around("write to", m) for m in mail] + [around("paid with", card(rng)) for _ in range(25)]
    hidden = "555-0199-777"
    glued = f"{phone[0]} {card(rng)}"
    rows += [around("please call", hidden), around("please call", hidden), around("write to", "root(at)corp"), around("write to", "root(at)corp"), around("ref", glued),
             around("version", "555-0100-222"), around("lot", "1234567890123456"), "clean text, version 4.0 of 2024", None, "", rows[0]]
    return rows, hidden, glued


def test_unseen_identifiers(spark):
    texts, hidden, glued = personal_rows()
    rows = [(k, t, *["c"] * 10) for k, t in enumerate(texts)] + [(None, texts[0], *[None] * 10)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASH}").repartition(3)
    found = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert len(found) == len(rows)
    for k, t, *_ in rows:
        assert [tuple(s) for s in found[k]["base"]] == naive_base(t or "")
        assert set(map(tuple, found[k]["base"])) <= set(map(tuple, found[k]["spans"]))
    new = {(k, t[s[1]:s[2]], s[0]) for k, t, *_ in rows if t for s in set(map(tuple, found[k]["spans"])) - set(map(tuple, found[k]["base"]))}
    at = {t: k for k, t, *_ in rows[:-1]}
    wanted = {(k, hidden, 3) for k, t, *_ in rows if t and hidden in t} | {(k, "root(at)corp", 0) for k, t, *_ in rows if t and "root(at)" in t}
    here = next(k for t, k in at.items() if t and glued in t)
    assert new == wanted | {(here, glued[:-17], 3), (here, glued[-16:], 2)}
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_rounds_reach_further(spark):
    """A promoted instance teaches a pattern of its own, which promotes what no seed's pattern reaches."""
    rows = [(f"call {p}", p) for p in ("+1 555 010 2000", "+1 555 010 2001", "+1 555 010 2002", "+1 555 010 2003", "+1 555 010 2004")]
    texts = [t for t, _ in rows] + [f"call 55{k}-0100-22" for k in range(6)] + [f"ring 55{k}-0100-22" for k in range(6)] + ["ring 777/1 4445556", "walk 999-0100-11"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = pii.scan(docs).select(F.inline("seen"))
    seen = seen.withColumn("patterns", F.expr("filter(patterns, p -> p not like 'S %')"))  # by context alone
    found = {r["instance"] for r in pii.bootstrap(seen, confident=0.8, promoted=0.8).collect()}
    assert {f"number 55{k}010022" for k in range(6)} <= found and "number 14445556" not in found and "number 999010011" not in found


# Hard negatives


def naive_negatives(rows, k=5):
    """All pairs, in whole numbers."""
    kept = [(r, i, label, [math.floor(256 * x) for x in v]) for r, (i, label, v) in enumerate(rows)
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    out = []
    for r, i, label, v in kept:
        if i is None or i % 100:
            continue
        scores = [(max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j, s, other) for s, j, other, w in kept if s != r and len(w) == len(v)]
        for p, pid, _, _ in sorted((x for x in scores if x[3] == label), key=order)[:k]:
            fits = sorted((x for x in scores if x[3] != label and 80 * p <= 100 * x[0] <= 100 * p), key=order)[:k]
            out += [(i, pid, n + 1, x[1], p, x[0]) for n, x in enumerate(fits)]
    return out


def embedding_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6))
    rows = [(k, int(k % 4), (centres[k % 4] + centres[(k + 1) % 4] + rng.normal(size=6) * 0.3).tolist()) for k in range(900)]
    rows += [(1000 + k, int(k % 3), centres[0].tolist()) for k in range(300)]  # one common vector
    nan, inf = float("nan"), float("inf")
    return rows + [(2000, 1, [0.0] * 6), (2001, None, [1.0] * 6), (2002, 1, None), (2003, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, 1, [nan] * 6), (2100, 2, [inf] * 6),
                   (None, 2, centres[2].tolist()), (None, 1, centres[1].tolist()), (2200, 0, []), (2201, 0, []), (2202, 1, []), (2300, 0, [1.0, 2.0]), (2301, 0, [2.0, 1.0]),
                   (2302, 3, [2.0, 0.9]), (300, 0, (centres[1] * 1.1).tolist()), (2400, 3, [1e9] * 6), (2401, 3, [1e9] * 6), (2402, 2, [0.9e9] * 6)]


def small_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "q") for r in rows],
                                 "vec_id bigint, label int, embedding array<double>, row string, region string, rank string, score string").repartition(3)


def test_hard_negatives(spark, monkeypatch):
    rows = embedding_rows()
    wanted = naive_negatives(rows)
    assert len(wanted) > 100
    table = small_table(spark, rows)
    same(map(tuple, rtree.hard_negatives(table, F.col("vec_id") % 100 == 0).collect()), wanted)
    # Many small regions and several parts per region, as a large table has.
    monkeypatch.setattr(rtree, "ANCHORS", 4)
    placed = rtree.tile
    monkeypatch.setattr(rtree, "tile", lambda r: placed(r, 100))
    same(map(tuple, rtree.hard_negatives(table, F.col("vec_id") % 100 == 0).collect()), wanted)
    assert rtree.hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert rtree.hard_negatives(table, F.col("vec_id") < 0).count() == 0


def test_regions_are_bounded(spark):
    table = small_table(spark, embedding_rows())
    sizes = rtree.tile(rtree.points(table), 100).groupBy("region").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 100 and sizes[1] == len(embedding_rows()) - 5


@pytest.mark.parametrize("n", [1, 255, 256, 3000])
def test_tree_prunes_and_finds(n):
    rng = np.random.default_rng(n)
    vectors = np.floor(256 * (rng.normal(size=(n, 3)) + 8 * rng.integers(0, 3, (n, 1)))).astype(np.int64)
    tree = rtree.Tree(np.arange(n), np.arange(n), rng.integers(0, 3, n), vectors)
    anchor = vectors[:1]
    low, high = tree.intervals(anchor.astype(float))
    order = np.lexsort((tree.rows, -(tree.vectors @ anchor[0])))
    wanted = order[(tree.labels[order] == 1) & (tree.rows[order] != 0)][:5]
    (at, _), = tree.search(0, anchor[0].astype(float), 1, [(-2**63 + 1, 2**63 - 1)], True, 5, low[0], high[0])
    assert at.tolist() == wanted.tolist()
    leaf = np.arange(n) // rtree.LEAF
    scores = tree.vectors @ anchor[0]
    assert all((low[0][leaf] <= scores) & (scores <= high[0][leaf]))

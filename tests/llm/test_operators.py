"""The training-data operators against brute force, on small tables with the cases that break things."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadspark.llm import bpe, extract, jaccard, minhash, mixing, pu, records, rules, sharding, suffix
from leadspark.operators import staging

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, size string, id string, tie string, name string"


def made_rows():
    """Near copies, shared passages, copies, repeats, nulls, empty, short and long texts."""
    rng = random.Random(3)
    vocabulary = ["The", "of", "und", "été", "naïve", "x1y", "don't", "Straße", "foo,", "bar!!", "<|endoftext|>"] + [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (40, 90, 150, 150, 400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(150))
    texts = []
    for k in range(70):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        texts.append(text + "\n" + passage + " end" if k % 9 == 0 else text)
    texts += texts[:12] + [None, "", " \n\t", "a", "A b", "a B", "ab " * 400, "é" * 900, "é" * 900, " ".join(rng.choice(vocabulary) for _ in range(20000)),
                           "one two three İΣ é", "x\x1cy\x85z"]
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, "a", "b", "c", "d") for k, t in enumerate(texts)]
    return rows + rows[3:6] + [(None, "null id text here", "s0", None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, wanted):
    assert Counter(map(repr, found)) == Counter(map(repr, wanted))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


# ------------------------------------------------------------------------------------------------- extraction

PAGES = {
    "<html><body><header><a href=x>Site</a></header><div id='content'><h1>T</h1><div class=body><p>One &amp; two three four five six."
    "<p>Next <b>b</b>old  part\nof it, long enough to count.</p></div><div class='comments'><p>I like this, dear author, thanks for all"
    "</p></div></div><aside>Side text</aside><form><input name=a>Search</form><footer>c</footer></body></html>":
        "T One & two three four five six. Next bold part of it, long enough to count.",
    "<body><nav><ul><li><a href=a>Home</a></ul></nav><div class=ad>Buy now</div><article><h1>Head</h1><p><b>Lead.<br><p>More &lt;x&gt;."
    "<script>var t='</p>';</script></article><footer>&copy;</footer>": "Head Lead. More <x>.",
    "": "", "plain &eacute; text": "plain é text", "<p>a<p>b": "a b", "<p>1 < 2": "1 < 2", "<article><p>x</p><section id='comments'>y</section></article>": "x",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c", "<p title='a>b'>q</p><!-- no -->": "q", "<div" * 50: "",
}


def test_main_text(spark):
    for page, text in PAGES.items():
        assert extract.main_text(page) == text
    assert extract.main_text(None) == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert extract.main_text(deep) == "deep"
    table = spark.createDataFrame([(k, p, "old") for k, p in enumerate([*PAGES, None])], "page_id int, html string, text string")
    found = extract.extract(table)
    same([tuple(r) for r in found.collect()], [(k, t, len(t)) for k, t in enumerate([*PAGES.values(), ""])])
    assert found.columns == ["page_id", "text", "n_chars"] and extract.extract(table.limit(0)).count() == 0


STORY = "A long paragraph of the story, with words enough to be most of what the page says to anyone. "
MORE_PAGES = {
    # End tags that HTML lets a page omit, in parts that are left out.
    f"<body><ul><li class='social'>X<li>Y</ul><p>{STORY}": f"Y {STORY}",
    f"<article><p class='ad'>Buy<br>now<p>{STORY}</article>": STORY, f"<article><p class='ad'>Buy<div>{STORY}</div></article>": STORY,
    f"<article><div><nav><a href=a>Home</div><p>{STORY}</article>": STORY,
    f"<article><dl><dt class=ad>Buy<dd>{STORY}</dl></article>": STORY,
    f"<article><table><tr class=ad><td>Buy<tr><td>{STORY}</table></article>": STORY,
    f"<article><table><thead class=ad><tr><td>Buy<tbody><tr><td>{STORY}</table></article>": STORY,
    f"<article><ul><li hidden>Buy<li>{STORY}</ul></article>": STORY, f"<article><p hidden>Buy<br>now<p>{STORY}</article>": STORY,
    f"<html><head><meta charset=utf-8><title>T</title><body><p>{STORY}": STORY, f"<head><title>T</title><p>{STORY}": STORY,
    f"<article><nav><ul><li>a<li>b</ul>c</nav><p>{STORY}</article>": STORY,
    f"<article><aside><table><tr><td>x</div></table>y</aside>{STORY}</article>": STORY,
    # Names do not drop an article, nor what holds most of the page.
    f"<div class='content-sidebar-wrap'><main><h1>T</h1><p>{STORY}</main><div class=sidebar>Side</div></div>": f"T {STORY}",
    f"<article class='post has-sidebar'><p>{STORY}<div class=widget>W</div></article>": STORY,
    f"<body><div class='social-story'><p>{STORY}<p>{STORY}</div><div class=ad>Buy</div>": STORY * 2,
    f"<body><article><h1>T</h1><p>{STORY}</article><div id=comments><p>{STORY}<p>{STORY}<p>{STORY}</div>": f"T {STORY}",
    # Only the attribute hides, not the word.
    f"<article><p title='the hidden truth'>{STORY}<p class='hidden x'>And more.<p style='display: none'>x<p aria-hidden=true>y</article>": f"{STORY}And more.",
}


def test_main_text_of_omitted_ends_and_names():
    for page, text in MORE_PAGES.items():
        assert extract.main_text(page) == text.strip(), page


# --------------------------------------------------------------------------------------------------- sharding

@pytest.mark.parametrize("shards", [4, 40])
def test_shards_are_even_and_keep_copies(spark, rows, docs, empty, shards):
    items = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("group"))
    found = sharding.assign(items, shards).collect()
    same([r["doc_id"] for r in found], [r[0] for r in rows])
    loads, slots = Counter(), defaultdict(list)
    for r in found:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) <= set(range(shards))
    assert max(loads.values()) <= sum(loads.values()) / shards + max(r["size"] for r in found)
    if shards == 4:
        spread = defaultdict(set)
        for r in found:
            spread[r["group"]].add(r["shard"])
        assert sum(len(s) for s in spread.values()) <= len(spread) + 5
    assert sharding.assign(items.where("false"), shards).count() == 0


def test_large_group_fills_shards(spark):
    items = spark.range(900).select(F.col("id").alias("doc_id"), F.lit(100).alias("size"), F.when(F.col("id") < 300, "hot").otherwise(
        F.concat(F.lit("g"), F.col("id"))).alias("group"))
    found = sharding.assign(items, 10).groupBy("shard").agg(F.count("*").alias("n"), F.count(F.when(F.col("group") == "hot", 1)).alias("hot")).collect()
    assert {r["n"] for r in found} <= {89, 90, 91} and sum(r["hot"] >= 80 for r in found) >= 2


def test_groups_touch_no_more_shards_than_they_need(spark):
    # A third of all rows in one group needs 14 of 40 shards; the rest are pairs and fours, so that nothing is mere filling.
    group = F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2000, F.concat(F.lit("p"), F.floor(F.col("id") / 2))).otherwise(
        F.concat(F.lit("t"), F.floor(F.col("id") / 4)))
    items = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(100).alias("size"), group.alias("group"))
    found = sharding.assign(items, 40).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(3000))
    assert set(Counter(r["shard"] for r in found).values()) <= {74, 75, 76}
    spread = defaultdict(set)
    for r in found:
        spread[r["group"]].add(r["shard"])
    assert len(spread["hot"]) <= 14
    assert sum(len(s) > 1 for g, s in spread.items() if g != "hot") <= 40


# ----------------------------------------------------------------------------------------- encoding and records

def test_bpe_equals_library(spark, rows, docs, empty, tokenizer):
    found = bpe.encode(docs, TOKENIZER).collect()
    wanted = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    same([tuple(r) for r in found], wanted)
    assert bpe.encode(empty, TOKENIZER).count() == 0


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 20000, dtype=np.uint8))

    def pieces(data):
        ends = bpe.chunk_ends(data)
        return {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    shared = pieces(b"head " + passage) & pieces(b"another, longer head " + passage + b" tail")
    assert sum(map(len, shared)) > 15000
    assert bpe.chunk_ends(b"") == [] and bpe.chunk_ends(b"abc") == [3]
    for end in bpe.chunk_ends("é".encode() * 5000):
        assert end % 2 == 0


def test_records_round_trip(spark, rows, docs, empty, tokenizer):
    index = records.write_records(docs, TOKENIZER, 2)
    found = records.read_records(records.with_starts(index)).collect()
    wanted = Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in found) == wanted
    at = 0
    ordered = sorted(found, key=lambda r: r["start"])
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert records.read_records(records.write_records(empty, TOKENIZER, 2)).count() == 0


def test_damaged_records_are_found():
    data = records.frame(b"payload")
    assert records.unframe(data) == b"payload" and records.unframe(records.frame(b"")) == b""
    for at in range(len(data)):
        with pytest.raises(records.BadRecord):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])
    with pytest.raises(records.BadRecord):
        records.unframe(data[:-1])


# ------------------------------------------------------------------------------------------------ Jaccard join

def components(rows):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[root(k)].append(r[0])
    lows = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(r[0], len(s), lows[root(k)]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_jaccard_components(spark, rows, docs, empty):
    found = jaccard.near_components(docs)
    same([tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()], components(rows))
    assert jaccard.near_components(empty).count() == 0
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns
    groups = {(r["component_id"], r["n_shingles"] == 0 and r["doc_id"]) for r in found.collect()}
    assert abs(one.count() - len(groups)) <= 1  # two rows without id


def near_group(size, seed=4):
    """Copies of one text of 150 words that replace one to five words each, the text itself, and others."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, size):
        words = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 3, 4, 5))):
            words[at] = rng.choice((f"x{rng.randrange(1000)}", f"y{rng.randrange(1000)}", "", words[at - 1]))
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("draws", [jaccard.DRAWS, 2])
def test_near_copies_of_one_text_are_not_all_pairs(spark, draws, monkeypatch):
    """Most of a large group of near copies is one component after a round; few pairs of the rest can be linked."""
    measured = []
    counted = jaccard._distances

    def count(pairs, sets, near):
        measured.append(pairs.count())
        return counted(pairs, sets, near)

    monkeypatch.setattr(jaccard, "_distances", count)
    monkeypatch.setattr(jaccard, "DRAWS", draws)
    rows = near_group(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = jaccard.near_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    same([tuple(r) for r in found], components(rows))
    assert draws == 2 or sum(measured) <= 10 * len(rows), measured


def test_regions_where_many_pairs_meet_are_divided(spark, monkeypatch):
    """Rounds of cells follow where the order of shingles tells too few members apart, with the same components."""
    divided = []
    counted = jaccard._join_round

    def count(*args):
        divided.append(1)
        return counted(*args)

    monkeypatch.setattr(jaccard, "_join_round", count)
    monkeypatch.setattr(jaccard, "DRAWS", 4)
    rng = random.Random(8)
    blocks = [[" ".join(f"b{k}v{v}w{i}" for i in range(8)) for v in range(2)] for k in range(12)]
    rows = [(k, " ".join(rng.choice(b) if rng.random() < 0.7 else b[0] for b in blocks)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = jaccard.near_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    same([tuple(r) for r in found], components(rows))
    assert divided


# ---------------------------------------------------------------------------------------- weak supervision, PU

def test_rule_counts(spark, rows, docs, empty):
    found = rules.judge(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    wanted = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i:i + 8])].append(i)
        covered = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        wanted.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)))
    same([tuple(r) for r in found.select("doc_id", *names).collect()], wanted)
    assert rules.judge(empty).count() == 0


def test_accuracies_follow_agreement():
    votes = [((1, 1, 1), 600), ((-1, -1, -1), 300), ((1, 1, -1), 60), ((-1, -1, 1), 40), ((0, 0, 0), 10)]
    accuracy = rules.estimate(votes)
    assert accuracy[0] > 0.95 and accuracy[1] > 0.95 and 0.8 < accuracy[2] < 0.95
    assert rules.posterior((0, 0, 0), 0.5, accuracy) == 0.5 and rules.posterior((1, 1, -1), 0.5, accuracy) > 0.9
    assert rules.estimate([]) == [0.8] * len(rules.RULES)


def test_classifier_separates(spark, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "river", "runs", "slow", "and", "wide"]) for _ in range(60)) + "." for _ in range(300)]
    bad = [" ".join(rng.choice(["BUY", "NOW", "###", "$$$", "!!!"]) for _ in range(60)) for _ in range(100)]
    data = [(k, t) for k, t in enumerate(good + bad)] + [(None, None), (900, "")]
    table = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(0, 400, 4)] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    scores = {r["doc_id"]: r["score"] for r in pu.classify(table, labels).collect()}
    assert len(scores) == 402 and all(0 <= s <= 1 for s in scores.values())
    assert sum((scores[k] >= 0.5) == (k < 300) for k in range(400)) >= 392
    assert pu.accepted(table, labels).columns == ["doc_id", "text"]
    assert pu.classify(table.limit(0), labels).count() == 0
    assert {r["score"] for r in pu.classify(table, labels.limit(0)).collect()} == {0.5}


def test_prior_of_the_unlabelled(spark):
    """Labels are all but good, half of all texts are not: the prior follows the texts. Extra columns are carried along."""
    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "river", "runs", "slow", "and", "wide"]) for _ in range(rng.randint(30, 90))) + "." for _ in range(400)]
    bad = [" ".join(rng.choice(["BUY", "NOW", "###", "$$$", "!!!"]) for _ in range(60)) for _ in range(400)]
    table = spark.createDataFrame([(k, t, 1, "x", 2.0) for k, t in enumerate(good + bad)], "doc_id bigint, text string, m int, _text string, score double")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 400, 2)] + [(400, 0)], "doc_id bigint, quality int")
    measures = table.select("doc_id", pu.measured(pu.F.col("text")).alias("m"))
    values = [tuple(r[0]) for r in measures.select("m").collect()]
    mean, scale = pu.np.mean(values, axis=0), pu.np.maximum(pu.np.std(values, axis=0), 1e-9)
    cells, rows = pu.cells(measures, mean, scale)
    assert rows.sum() == 800 and len(rows) < 100
    same_mean = (cells * rows[:, None]).sum(axis=0) / 800
    clipped = pu.np.clip((pu.np.array(values) - mean) / scale, -pu.FAR, pu.FAR)
    assert abs(same_mean - clipped.mean(axis=0)).max() < 1e-5
    kept = pu.accepted(table, labels)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & set(range(400))) >= 396 and len(ids - set(range(400))) <= 4
    assert abs(pu.estimated_prior(pu.np.array([0, 0, 100]), pu.np.array([5000, 0, 5000]), 10_000) - 0.5) < 1e-9


# ------------------------------------------------------------------------------------------------------ mixing

def test_mix_meets_targets(spark, rows, docs, empty):
    mixed = mixing.mix(docs)
    found = mixed.collect()
    same([(r["doc_id"], r["size"]) for r in found], [(r[0], len(WORD.findall(r[1] or ""))) for r in rows])
    total = sum(r["size"] for r in found)
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["placements"])
        assert all(0 <= p["position"] <= 1 for p in r["placements"])
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-9 and abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 1
    positions = [r["position"] for r in mixing.curriculum(mixed).collect()]
    assert positions == sorted(positions)
    assert mixing.mix(empty).count() == 0


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 500), (None, 90)], "source string, size bigint")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # Weights 5, 2, 1, 5; "a" stops at 30 and the last at 270, "b" at 300; "c" takes what is left.
    level = {k: v for k, v in found.items()}
    assert level["a"] == 30 and level[None] == 270 and abs(sum(level.values()) - 700) < 1e-9 and level["b"] <= 300


def test_schedules_are_inverted(spark):
    share = spark.range(101).select((F.col("id") / 100).alias("u"))
    for lo, hi in mixing.RAMPS:
        t = np.array([r[0] for r in share.select(mixing.due(F.col("u"), F.lit(lo), F.lit(hi))).collect()])
        tilt = (hi - lo) / (hi + lo)
        assert np.allclose(t + tilt * (t * t - t), np.linspace(0, 1, 101))


# ------------------------------------------------------------------------------------------------------ suffixes

def repeated(rows, length=400):
    starts = defaultdict(list)
    texts = [(r[1] or "").encode() for r in rows]
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            starts[hash(t[p:p + length])].append((k, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for v in starts.values():
        if len(v) > 1:
            for k, p in v:
                gone[k][p:p + length] = True
    out = []
    for r, t, g in zip(rows, texts, gone, strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        out.append((r[0], len(t), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("largest", [suffix.BLOCK, 3])
def test_repeated_strings_go(spark, rows, docs, empty, largest):
    found = suffix.dedup(docs, largest=largest)
    assert found.columns == [*[c for c in docs.columns if c != "text"], "n_bytes", "n_removed", "n_spans", "kept"]
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect()], repeated(rows))
    assert suffix.dedup(empty).count() == 0


def test_partly_repeated_characters_stay():
    text = "aéb".encode()
    assert suffix.whole_characters(text, [(0, 2)]) == [(0, 1)] and suffix.whole_characters(text, [(2, 4)]) == [(3, 4)]
    assert suffix.whole_characters(text, [(2, 3)]) == [] and suffix.whole_characters(text, [(0, 2), (1, 4)]) == [(0, 4)]


# --------------------------------------------------------------------------------------------------- fingerprints

def test_fingerprints(spark, rows, docs, empty):
    found = minhash.compare_with_edits(docs).withColumn("print", minhash.as_text(F.col("fp"))).collect()
    order = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}, key=lambda x: -x[0])
    prints, by = {}, {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert len(found) == len(rows)

    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for (doc_id, text), (_, after) in zip(order, order[1:], strict=False):
        r = by[doc_id]
        m = len(text) // 3
        edited = text[:len(text) - m] + after[:m]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["print"]) == r["print"]
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            assert abs(r[name] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert minhash.compare_with_edits(empty).count() == 0


def repeated_words(rows, length):
    """Per row the word places that a string of so many words covers which also starts elsewhere."""
    words = [(t or "").encode().split() for _, t in rows]
    starts = defaultdict(list)
    for r, w in enumerate(words):
        for k in range(len(w) - length + 1):
            starts[tuple(w[k:k + length])].append((r, k))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for r, k in places:
                gone[r].update(range(k, k + length))
    return words, gone


@pytest.mark.parametrize("largest", [suffix.BLOCK, 2])
def test_repeated_passages_of_words(spark, largest):
    rng = random.Random(6)
    passages = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 56, 62, 130))]
    rows = []
    for k in range(60):
        own = [f"é{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 120))]
        at = rng.randrange(len(own))
        middle = passages[k % 6] if k < 40 else passages[k % 6][:49] if k < 50 else []
        gap = rng.choice([" ", "\n", "  \t"])
        rows.append((k, " ".join(own[:at]) + gap + gap.join(middle) + " " + " ".join(own[at:])))
    rows += [(100, rows[0][1]), (101, "a " * 300), (102, None), (103, ""), (104, " ".join(passages[1])), (None, " ".join(passages[1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    unit = suffix.Unit(50, words=True)
    found = {r["doc_id"]: r for r in suffix.dedup(docs, largest=largest, unit=unit).collect()}
    for (k, t), words, gone in zip(rows, *repeated_words(rows, 50), strict=True):
        kept = [w for i, w in enumerate(words) if i not in gone]
        assert bytes(found[k]["kept"]).split() == kept and (found[k]["n_removed"] > 0) == bool(gone)
        assert gone or bytes(found[k]["kept"]) == (t or "").encode()


def test_frequent_passage_hands_on_few_rows(spark, monkeypatch):
    """Texts round one passage: what a block hands on are ranges of starts, and suffixes only where ranges meet."""
    counts = []

    def written(df):
        table = staging.materialize(df)
        counts.append(table.count())
        return table

    monkeypatch.setattr(suffix, "materialize", written)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"a{k}x{i}" for i in range(45)) + f" {passage} " + " ".join(f"z{k}x{i}" for i in range(45))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: bytes(r["kept"]).split() for r in suffix.dedup(docs, largest=20, unit=suffix.Unit(50, words=True)).collect()}
    for (k, _), words, gone in zip(rows, *repeated_words(rows, 50), strict=True):
        assert found[k] == [w for i, w in enumerate(words) if i not in gone]
    assert len(found[0]) == 90
    assert max(counts) <= 25 * len(rows), counts


@pytest.mark.parametrize("near", [80, 90])
def test_shared_passages_are_not_all_pairs(spark, near, monkeypatch):
    """Texts that share one passage of 170 words and differ in 30, each with one near copy: what is measured grows with the texts."""
    measured = {}
    counted = jaccard._distances

    def count(pairs, sets, near):
        measured[size] += pairs.count()
        return counted(pairs, sets, near)

    monkeypatch.setattr(jaccard, "_distances", count)
    passage = " ".join(f"shared{k}" for k in range(170))
    for size in (100, 400):
        measured[size] = 0
        texts = [f"{passage} " + " ".join(f"own{k // 2}x{i}" for i in range(30)) + (" changed" if k % 2 else "") for k in range(size)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_components(docs, near=near).collect()}
        assert got == {k: k // 2 * 2 if near == 90 else got[k] for k in range(size)}
    assert measured[400] <= 5 * measured[100]


def test_clashing_columns(spark, rows):
    names = "doc_id bigint, text string, source string, weight string, linked string, shard int, slot int, settled string, ramp_from string, ramp_to string, _source string"
    docs = spark.createDataFrame([(r[0], r[1], r[2], "w", "l", 7, 8, "s", "f", "t", "o") for r in rows], names)
    items = docs.select("*", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.md5("text").alias("group"))
    placed = sharding.assign(items, 4)
    assert len(set(placed.columns)) == len(placed.columns) and placed.where("weight = 'w' and linked = 'l' and settled = 's'").count() == len(rows)
    assert placed.groupBy("shard").agg(F.max("slot") + 1 == F.count("*")).where("not `((max(slot) + 1) = count(1))`").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.where("ramp_from = 'f' and ramp_to = 't' and _source = 'o' and weight = 'w'").count() == len(rows)
